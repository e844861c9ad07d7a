import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.functions.prune import may_match
from orrery.llm import exact_dedup as X

from .common import SCHEMA, frame, hard_rows, texts


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))], ids=["xxhash", "clashing"])
def test_against_brute_force(spark, sf, hashed):
    rows = hard_rows(texts(spark, sf))
    got = X.exact_dedup(frame(spark, rows), hashed=hashed).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected([r[:2] for r in rows])
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(r[1]) for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_chunks_join_to_the_text(spark, sf):
    df = frame(spark, hard_rows(texts(spark, sf)))
    n = X.normalised(F.col("text"))
    assert df.where(F.encode(F.array_join(X.chunks(n), ""), "ISO-8859-1") != F.encode(n, "UTF-8")).count() == 0


R = random.Random(5)
SAMPLES = {
    "cyrillic": " ".join(R.choice("привет мир как дела хорошо сегодня погода и в на не что это человек время".split()) for _ in range(6000)),
    "chinese": "".join(chr(R.randrange(0x4E00, 0x5A00)) for _ in range(15_000)),
    "digits": "".join(R.choice("0123456789") for _ in range(40_000)),
    "capitals": " ".join("".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(R.randrange(2, 9))) for _ in range(6000)),
    "binary digits": "".join(R.choice("01") for _ in range(40_000)),
    "emoji": "".join(chr(R.randrange(0x1F600, 0x1F640)) for _ in range(15_000)),
}


def test_chunks_are_content_defined(spark, sf):
    samples = SAMPLES | {"prose": " ".join(texts(spark, sf, 40))}
    df = spark.createDataFrame([(k, p + t) for k, t in samples.items() for p in ("", "123456789")], "kind string, text string")
    found = {}
    for r in df.select("kind", X.chunks(X.normalised(F.col("text"))).alias("c")).collect():
        found.setdefault(r.kind, []).append(r.c)
    for kind, (a, b) in found.items():
        assert len(set(a) & set(b)) >= 0.9 * len(a), kind
        assert sorted(map(len, a))[len(a) // 2] < 1000, kind
        assert all(len(c) <= X.MOST for c in a)


def test_only_chunks_of_repeated_hashes_are_compared(spark):
    docs = [(i, SAMPLES["digits"][i * 3000 : i * 3000 + 3000]) for i in range(10)] + [(20, SAMPLES["capitals"])]
    pieces = spark.createDataFrame(docs, "doc_id long, text string").select(F.explode(X.chunks(F.col("text"))).alias("content")).select(F.xxhash64("content").alias("h"), "content")
    assert may_match(pieces, pieces.limit(0).select("h"), "h").count() == 0
    one = pieces.select("h").limit(1)
    assert may_match(pieces, one, "h").join(one, "h", "left_anti").count() < 3


def test_keep_first_has_one_row_of_each_text(spark, sf):
    rows = hard_rows(texts(spark, sf))
    df = frame(spark, rows)
    got = X.keep_first(df)
    assert got.columns == df.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(r[1]) for r in rows})


def test_same_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (1, "b"), (3, "c")], "doc_id long, text string")
    assert sorted(map(tuple, X.keep_first(df).collect())) == [(1, "a"), (1, "b"), (3, "c")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.exact_dedup(df).count() == 0 and X.keep_first(df).count() == 0


def test_clashing_columns_are_carried(spark):
    names = "doc_id long, text string, r string, i long, t string, sha string, kept boolean, row_id long, recipe string, n long"
    rows = [(1, "a", "x", 1, "y", "z", True, 1, "q", 1), (2, "a", "x", 1, "y", "z", True, 1, "q", 1), (3, "b", "x", 1, "y", "z", False, 1, "q", 1), (3, "b", "x", 1, "y", "z", False, 1, "q", 1)]
    df = spark.createDataFrame(rows, names)
    got = X.keep_first(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert X.exact_dedup(df).count() == 4
