import hashlib
import random
import re
import time

import pytest

from orrery.llm import decontam as D

from .common import SCHEMA, frame, hard_rows, texts


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        wins += [(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1) if n]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted(base):
    r = random.Random(3)
    items = [(100 + i, " ".join(words(t)[5:40])) for i, t in enumerate(base[:8])]
    items += [(7, "one"), (7, "one"), (8, "ÜNÏcödé 🙂"), (9, None), (10, "!!"), (11, "a b c d a b c d a b c d"), (12, "never seen in any text at all not even once here"), (None, "one word")]
    docs = list(base)
    for i in range(12):
        w = words(items[i % 8][1])
        a = r.randrange(max(1, len(w) - 12))
        docs.append("Before it. " + ", ".join(w[a : a + r.choice([8, 9, 10, 11, 14])]).upper().replace("É", "é") + " after\nit")
    return docs, items


def test_against_brute_force(spark, sf):
    docs, items = planted(texts(spark, sf, 40))
    rows = hard_rows(docs)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, pos int")
    got = D.decontaminate(frame(spark, rows), bench).collect()
    want = brute([x[:2] for x in rows], items)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert all(r.n_near >= r.n_items for r in got) and any(r.n_near > r.n_items for r in got)
    clean = D.drop_contaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns and clean.count() == sum(not w[5] for w in want)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    items = [(1, "p q r s t u v w x y z"), (2, "q r")]
    docs = [(1, "p q r s t u v w x y z " * 3), (2, "q r q r"), (3, "q"), (4, None)]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, items).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.decontaminate(one, items).collect()] == [(1, 2, 0, 0)]
    assert D.drop_contaminated(one, items).count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x a b"), (2, "a x x x x b"), (3, "b a a"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    got = {(r.doc_id, r.a, r.b): r.n for r in D.proximity_hits(docs, pairs, 2).collect()}
    assert got == {(1, "a", "b"): 1, (3, "a", "b"): 2, (3, "a", "a"): 2}


def test_the_index_has_every_token(spark):
    docs = spark.createDataFrame([(1, "B a b"), (2, "b"), (3, None)], "doc_id long, text string")
    index = D.build_index(docs)
    ids = {r.row: r.doc_id for r in D.documents(index).collect()}
    assert sorted((r.doc_id, r.n_words) for r in D.documents(index).collect()) == [(1, 3), (2, 1), (3, 0)]
    assert sorted((r.term, ids[r.row], r.pos) for r in index.where("term <> ''").collect()) == [("a", 1, 1), ("b", 1, 0), ("b", 1, 2), ("b", 2, 0)]


def near_items(docs, items, slop=10):
    """Items with a window whose two rarest terms (by count, then place) stand near each other, for each document."""
    lists = [words(t) for _, t in docs]
    count = {}
    for w in lists:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = []
    for (i, _), w in zip(docs, lists, strict=True):
        found = set()
        for item, t in items:
            q = words(t)
            n = min(10, len(q))
            for s in range(len(q) - n + 1) if n else []:
                cells = sorted((count.get(x, 0), k, x) for k, x in enumerate(q[s : s + n]))
                a, b = cells[0][2], cells[min(1, n - 1)][2]
                if cells[0][0] and any(w[p] == a and (n == 1 or any(p != r and w[r] == b for r in range(max(0, p - slop), min(len(w), p + slop + 1)))) for p in range(len(w))):
                    found.add(item)
        out.append((i, len(found)))
    return sorted(out)


def test_proximity_matches(spark, sf):
    docs, items = planted(texts(spark, sf, 30))
    docs, items = list(enumerate(docs)), [x for x in items if x[0] is not None]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_near) for r in got) == near_items(docs, items)


def test_a_repeated_word_costs_in_proportion(spark):
    docs = [(1, "a " * 8000), (2, "a " * 9 + "b"), (3, "a " * 12)]
    items = [(1, "a " * 800), (2, "a " * 9)]
    began = time.time()
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert time.time() - began < 60
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.n_near) for r in got) == [(1, 8000, 8000, 2, 2), (2, 10, 9, 1, 2), (3, 12, 12, 2, 2)]


def test_a_row_that_a_third_of_the_table_repeats(spark):
    hot = "p q r s t u v w x y z " * 3
    docs = [(i, hot if i % 3 == 0 else f"word{i} p q r s t u v w x") for i in range(300)]
    items = [(1, "p q r s t u v w x y z"), (2, "q r")]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(docs, items)


def test_clashing_columns_are_carried(spark):
    names = "doc_id long, text string, row long, pos int, h long, i long, r string, term string, text_hash long"
    docs = spark.createDataFrame([(1, "q r", 1, 1, 1, 1, "r", "t", 1), (2, "clean", 1, 1, 1, 1, "r", "t", 1)], names)
    items = spark.createDataFrame([(1, "q r")], "item_id long, text string")
    got = D.drop_contaminated(docs, items)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [2]
    assert D.decontaminate(docs, items).count() == 2
