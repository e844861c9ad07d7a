import random
import zlib
from collections import Counter
from math import comb

import pytest

from orrery.llm import sharding as S

from .common import SCHEMA, frame, hard_rows, texts


def test_hypergeometric_law():
    rng = random.Random(1)
    n = Counter(S.hypergeometric(rng, 7, 9, 6) for _ in range(40_000))
    for k in range(7):
        p = comb(7, k) * comb(9, 6 - k) / comb(16, 6)
        assert abs(n[k] / 40_000 - p) < 0.01
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3 and S.hypergeometric(rng, 4, 4, 8) == 4
    assert abs(S.hypergeometric(rng, 10**9, 10**9, 10**6) - 500_000) < 5000


def test_matrix_has_exact_margins():
    blocks = [0, 5, 17, 100, 3]
    m = S.communication_matrix(blocks, 24, 3)
    assert [sum(r) for r in m] == blocks
    sums = [sum(c) for c in zip(*m, strict=True)]
    assert sums == [6] * 5 + [5] * 19 and min(min(r) for r in m) >= 0


@pytest.mark.parametrize("per_block", [20_000, 3])
def test_documents(spark, sf, per_block, monkeypatch):
    rows = hard_rows(texts(spark, sf))
    df = frame(spark, rows)
    monkeypatch.setattr(S.uniform_shards, "__defaults__", (*S.uniform_shards.__defaults__[:-1], per_block))
    got = S.shard_documents(df).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.get(i, 0) for i in range(24)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    again = S.shard_documents(df.repartition(3)).collect()
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in again if r.doc_id is not None} == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got if r.doc_id is not None}


def test_places_are_uniform(spark):
    # Over many seeds every row is about as often in any shard.
    df = spark.range(40).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    n = Counter()
    for seed in range(30):
        for r in S.shard_documents(df, shards=4, seed=100 * seed).collect():
            n[(r.doc_id % 4, r.shard)] += 1
    assert all(abs(v - 75) < 40 for v in n.values()) and len(n) == 16


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_a_third_of_the_table_repeats_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    rows = [(7, "the same row")] * 600 + [(i, f"text {i}") for i in range(1000, 2200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = S.uniform_shards
    monkeypatch.setattr(S, "uniform_shards", lambda r, by, *a: (seen.append((r, by)), plain(r, by, *a))[1])
    got = S.shard_documents(df).collect()
    assert Counter(r.doc_id for r in got)[7] == 600
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)
    placed, by = seen[0]
    assert placed.select(*by).distinct().count() == 1800
