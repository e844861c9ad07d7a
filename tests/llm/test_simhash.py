import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import simhash as S

from .common import SCHEMA, frame, hard_rows, texts


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB \t\n\x1c\x85 éÉ", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def components_of(keys, links):
    label = {k: k for k in keys}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def brute(keys, errors=4):
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (a ^ b).bit_count() <= errors]
    return components_of(keys, links)


@pytest.mark.parametrize("seed", range(6))
def test_trie_forest(seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    keys = set()
    for _ in range(400):
        k = r.choice(centres)
        for b in r.sample(range(64), r.randrange(7)):
            k ^= 1 << b
        keys.add(k)
    keys = sorted(keys)
    label = S.trie_forest(np.array(keys, np.uint64), 0, slab=r.choice([3, 50, 1 << 18]))
    want = brute(keys)
    assert [keys[i] for i in label] == [want[k] for k in keys]


def test_chain_of_single_bits_is_one_component(spark):
    k, keys = 0, [0]
    for b in range(64):
        k ^= 1 << b
        keys.append(k)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in keys], "fp long")
    roots = {r.u: r.root for r in S.components(S.links(df)).collect()}
    assert len(roots) == 64 and len(set(roots.values())) == 1


def test_against_brute_force(spark, sf):
    base = texts(spark, sf)
    r = random.Random(5)
    more = []
    for t in base[:25]:
        w = t.split(" ")
        if len(w) > 30:
            w[r.randrange(len(w))] = "changed"
            more.append(" ".join(w))
    rows = hard_rows(base + more)
    got = S.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(x[1]) for x in rows]
    comp = brute(sorted(set(fps)))
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        c = comp[f]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((x[0], f"{f:016x}", least.get(comp[f])) for x, f in zip(rows, fps, strict=True)), key=str)
    assert sorted(((g.doc_id, g.fingerprint, g.component_id) for g in got), key=str) == want


@pytest.mark.parametrize(("bits", "errors"), [(64, 4), (32, 2)])
def test_hot_buckets_are_dealt_out_again(spark, monkeypatch, bits, errors):
    monkeypatch.setattr(S, "MOST", 60)
    r, keys = random.Random(bits), set()
    base = r.getrandbits(bits)
    # Two thirds share one block's value, so that it is dealt out again and again.
    for i in range(180):
        k = base if i % 3 else r.getrandbits(bits)
        for b in r.sample(range(bits // 3), r.randrange(7)):
            k ^= 1 << b
        keys.add(k)
    keys = [k << 64 - bits for k in sorted(keys)]
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    rows = S.buckets(df.withColumn("fp", df["key"]), bits, errors).collect()
    sizes, together = {}, set()
    for x in rows:
        sizes.setdefault((x.path, x.top), []).append(x.fp % (1 << 64))
    for (path, _), own in sizes.items():
        assert len(own) <= 60 or bits - S._fixed(path, bits, errors + 1) < errors + 1
        together |= {(a, b) for a in own for b in own if a < b}
    near = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (a ^ b).bit_count() <= errors}
    assert near and near <= together and max(x.path for x in rows) > errors + 1


@pytest.mark.parametrize("most", [1 << 21, 10])
def test_links_of_any_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "TOGETHER", 50)
    r, keys = random.Random(9), set()
    centres = [r.getrandbits(64) for _ in range(5)]
    for _ in range(300):
        k = r.choice(centres)
        for b in r.sample(range(64), r.randrange(6)):
            k ^= 1 << b
        keys.add(k)
    keys = sorted(keys)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in keys], "fp long")
    found = [(x.u % (1 << 64), x.v % (1 << 64)) for x in S.links(df).collect()]
    assert components_of(keys, found) == brute(keys)


def test_a_large_group_of_near_copies_is_walked_quickly():
    # All subsets of 14 bits: 16,384 fingerprints, most pairs within reach of each other.
    keys = np.arange(1 << 14, dtype=np.uint64) << np.uint64(20)
    assert (S.trie_forest(keys, 0) == 0).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0
