import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import knn, verify
from orrery.queries import knn as queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vecs, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], i % 4) for i, v in enumerate(vecs)], SCHEMA)


def triples(df):
    return sorted((r.query_id, r.rank, r.neighbor_id) for r in df.collect())


METRICS = [("L2", None), ("DOT", None), ("L1", None), ("COSINE", "proper"), ("COSINE", "assume_normalized")]


@pytest.mark.parametrize(("metric", "mode"), METRICS)
@pytest.mark.parametrize("case", ["random", "ties", "far_from_zero", "zeros", "dimension_one"])
def test_plans_agree_bit_for_bit(spark, metric, mode, case):
    r = np.random.default_rng(7)
    b = {"random": r.normal(size=(300, 8)), "ties": r.integers(0, 2, (300, 5)), "far_from_zero": 1e6 + r.normal(size=(200, 6)), "zeros": np.zeros((40, 3)), "dimension_one": r.integers(-3, 4, (80, 1))}[case]
    base, queries = frame(spark, b).repartition(5), frame(spark, b[:7] + (case == "random") * 0.1, 1000)
    x, y = (knn.knn(base, queries, 6, metric, mode, p).orderBy("query_id", "rank").collect() for p in ("sql", "blocks"))
    assert x == y and len(x) == 42


def test_order_is_distance_then_ordinal(spark):
    base = frame(spark, [[1, 0]] * 5 + [[0, 0]])
    got = knn.knn(base, frame(spark, [[0, 0]]), 3)
    assert triples(got) == [(0, 0, 5), (0, 1, 0), (0, 2, 1)]


def test_k_beyond_the_base_is_padded(spark):
    got = knn.knn_arrays(knn.knn(frame(spark, [[0], [3]]), frame(spark, [[1]]), 4), 4).first()
    assert got.indices == [0, 1, -1, -1] and got.distances == [1.0, 4.0, math.inf, math.inf]


@pytest.mark.parametrize("plan", ["sql", "blocks"])
def test_nan_and_infinity_are_no_neighbours(spark, plan):
    base = frame(spark, [[math.nan, 0], [math.inf, 0], [1, 1], [2, 2]])
    assert triples(knn.knn(base, frame(spark, [[0, 0]]), 4, plan=plan)) == [(0, 0, 2), (0, 1, 3)]


def test_signs(spark):
    base, q = frame(spark, [[3, 4], [0, 0]]), frame(spark, [[3, 4]])
    want = {("L2", None): [(0, 0.0), (1, 25.0)], ("DOT", None): [(0, 25.0), (1, 0.0)], ("L1", None): [(0, 0.0), (1, 7.0)], ("COSINE", "proper"): [(0, 1.0), (1, 0.0)]}
    for (m, c), w in want.items():
        assert [(r.neighbor_id, r.distance) for r in knn.knn(base, q, 2, m, c).orderBy("rank").collect()] == w


def test_cosine_needs_a_mode(spark):
    with pytest.raises(ValueError, match="cosine_mode"):
        knn.resolved("COSINE", None)
    with pytest.raises(ValueError):
        knn.resolved("L2", "proper")
    with pytest.raises(ValueError, match="unknown metric"):
        knn.resolved("L7", None)
    assert knn.resolved("euclidean", None) == "L2" and knn.resolved("ip", None) == "DOT"


def test_empty_sides(spark):
    some = frame(spark, [[1, 2]])
    assert knn.knn(some, some.limit(0), 3).count() == 0 and knn.knn(some.limit(0), some, 3).count() == 0


def test_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_FLOATS", 6)
    r = np.random.default_rng(1).normal(size=(50, 3))
    b, q = frame(spark, r), frame(spark, r[:9])
    assert triples(knn.knn(b, q, 4)) == triples(knn.knn(b, q, 4, plan="sql"))


def test_filtered(spark):
    r = np.random.default_rng(2).normal(size=(60, 4))
    b, q = frame(spark, r), frame(spark, r[:5])
    passing = spark.createDataFrame([(i, o) for i in range(5) for o in (*range(i, 60, 3), 999)], "query_id long, ordinal long")
    pre = knn.prefiltered_knn(b, q, passing, 5)
    allowed = {(r.query_id, r.ordinal) for r in passing.collect()}
    assert {(r.query_id, r.neighbor_id) for r in pre.collect()} <= allowed
    post = knn.postfiltered_knn(knn.knn(b, q, 60), passing)
    assert triples(verify.first_ranks(post, 5)) == triples(pre)


def test_post_filter_keeps_order(spark):
    g = spark.createDataFrame([(q, r, o) for q, row in enumerate([[10, 20, 30, 40], [5, 15, 25, 35], [1, 2, 3, 4]]) for r, o in enumerate(row)], "query_id long, rank int, neighbor_id long")
    p = spark.createDataFrame([(q, o) for q, s in enumerate([[20, 40, 99], [5, 100], [1, 2, 3, 4, 50, 60]]) for o in s], "query_id long, ordinal long")
    assert triples(knn.postfiltered_knn(g, p)) == [(0, 0, 20), (0, 1, 40), (1, 0, 5), (2, 0, 1), (2, 1, 2), (2, 2, 3), (2, 3, 4)]


def test_distances_of_missing_rows(spark):
    b, q = frame(spark, [[0], [2]]), frame(spark, [[1]])
    g = spark.createDataFrame([(0, 0, 1), (0, 1, -1)], "query_id long, rank int, neighbor_id long")
    assert [r.distance for r in knn.knn_distances(g, b, q).orderBy("rank").collect()] == [1.0, math.inf]
    with pytest.raises(Exception, match="no base row 7"):
        knn.knn_distances(g.withColumn("neighbor_id", F.lit(7).cast("long")), b, q).collect()


def test_sized_profiles_are_prefixes(spark):
    r = np.random.default_rng(3).normal(size=(90, 4))
    b, q = frame(spark, r), frame(spark, r[:4])
    got = knn.sized_knn(b, q, [10, 40, 90], 5)
    for n in (10, 40, 90):
        assert triples(got.where(f"size = {n}")) == triples(knn.knn(b.where(f"vec_id < {n}"), q, 5))


def test_partitions(spark):
    b = frame(spark, [(i + 1, 2 * i + 1) for i in range(20)])
    p = knn.partition_profiles(b)
    assert sorted((r.label, r.ordinal, r.id) for r in p.collect()) == sorted((i % 4, i // 4, i) for i in range(20))
    with pytest.raises(ValueError, match="more than 3"):
        knn.partition_profiles(b, most=3)
    assert knn.partition_profiles(b, least=6).count() == 0
    near = knn.partitioned_knn(b, frame(spark, [(0, 0)] * 4), 3)
    assert all(r.neighbor_id % 4 == r.label for r in near.collect()) and near.count() == 12


@pytest.mark.parametrize(("a", "b", "verdict", "n"), [([1, 2, 3], [1, 2, 3], "exact", 0), ([1, 2, 3], [3, 2, 1], "set", 0), ([1, 2, 3], [1, 2, 9], "boundary", 1), (list(range(6)), list(range(10, 16)), "real", 6), ([1, -1], [1, -1, -1], "exact", 0)])
def test_compare(spark, a, b, verdict, n):
    x, y = (spark.createDataFrame([(0, r, i) for r, i in enumerate(v)], "query_id long, rank int, neighbor_id long") for v in (a, b))
    assert [tuple(r) for r in verify.knn_compare(x, y).collect()] == [(0, verdict, n)]


def test_shift_histogram(spark):
    g = spark.createDataFrame([(0, r, r) for r in range(10)], "query_id long, rank int, neighbor_id long")
    f = g.where("neighbor_id >= 4").withColumn("rank", F.col("rank") - 4)
    assert {r.bin: r.n for r in verify.shift_histogram(g, f).collect()} == {4: 6}


@pytest.mark.parametrize(("metric", "dtype"), [("L2", np.float32), ("DOT", np.float32), ("COSINE", np.float64), ("L1", np.float32)])
def test_tiles_give_the_exact_neighbours(metric, dtype, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 37)
    monkeypatch.setattr(knn, "CELLS", 370)
    monkeypatch.setattr(knn, "RESCORED", 100)
    r = np.random.default_rng(5)
    b, q = r.normal(size=(400, 9)).astype(dtype), r.normal(size=(50, 9)).astype(dtype)
    b[100:140] = b[60:100]  # ties
    best = knn.Nearest(q, 7, metric)
    for x in range(0, 400, 90):
        best.add(np.arange(x, min(400, x + 90)), b[x : x + 90])
    i, j = np.divmod(np.arange(50 * 400), 400)
    full = knn._exact(metric, q[i].astype(float), b[j].astype(float)).reshape(50, 400)
    want = np.lexsort((np.broadcast_to(np.arange(400), full.shape), full), axis=1)[:, :7]
    assert (best.id == want).all() and (best.kernel == np.take_along_axis(full, want, 1)).all()


def test_memory_of_a_worker_is_bounded_by_tiles():
    r = np.random.default_rng(6)
    q, b = r.normal(size=(3000, 384)).astype(np.float32), r.normal(size=(6000, 384)).astype(np.float32)
    tracemalloc.start()
    best = knn.Nearest(q, 100, "L2")
    best.add(np.arange(len(b)), b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and np.isfinite(best.kernel).all()


def test_floats_out_of_range_are_taken_as_doubles(spark):
    base = frame(spark, [[1e30, 0], [1e30, 1e25], [3, 4]])
    got = knn.knn(base, frame(spark, [[1e30, 0]]), 3)
    assert triples(got) == triples(knn.knn(base, frame(spark, [[1e30, 0]]), 3, plan="sql"))


@pytest.mark.parametrize(("metric", "mode"), METRICS)
@pytest.mark.parametrize("case", ["random", "ties", "far_from_zero", "zeros", "dimension_one", "odd"])
def test_direct_plan_agrees_bit_for_bit(spark, monkeypatch, metric, mode, case):
    monkeypatch.setattr(knn, "ROWS", 37)
    monkeypatch.setattr(knn, "CACHED", 100)
    monkeypatch.setattr(knn, "RESCORED", 150)
    r = np.random.default_rng(8)
    b = {"random": r.normal(size=(300, 8)), "ties": r.integers(0, 2, (300, 5)), "far_from_zero": 1e6 + r.normal(size=(200, 6)), "zeros": np.zeros((40, 3)), "dimension_one": r.integers(-3, 4, (80, 1)), "odd": [[math.nan, 0], [0, math.nan], *r.normal(size=(30, 2))]}[case]
    base, queries = frame(spark, b).repartition(3), frame(spark, b[5:12], 1000)
    x, y = (knn.knn(base, queries, 6, metric, mode, p).orderBy("query_id", "rank").collect() for p in ("sql", "direct"))
    assert x == y and len(x) == 42


def test_the_direct_engine_differs_where_the_tiles_are_wrong(spark, monkeypatch):
    b = np.random.default_rng(9).normal(size=(200, 8))
    right = knn._exact
    monkeypatch.setattr(knn, "_exact", lambda name, q, v: right(name, q, v) * (1 + (v[:, 0] > 0)))
    tiles, direct = knn.Nearest(b[:5], 4, "L2"), knn.Direct(b[:5], 4, "L2")
    for e in (tiles, direct):
        e.add(np.arange(200), b)
    full = ((b[:5, None] - b[None]) ** 2).sum(2)
    assert (tiles.kernel != direct.kernel).any() and np.allclose(direct.kernel, np.sort(full, 1)[:, :4])
    assert (direct.id == np.argsort(full, 1)[:, :4]).all()


def test_engine_parity_joins_no_pairs(spark, sf):
    plan = queries.QUERIES["engine_parity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan and plan.count("MapInArrow") == 8


@pytest.mark.parametrize(("metric", "mode"), METRICS)
@pytest.mark.parametrize("plan", ["blocks", "direct", "sql"])
def test_shared_filters_give_the_same_as_pairs(spark, metric, mode, plan):
    r = np.random.default_rng(10)
    v = r.normal(size=(90, 5))
    v[30:40] = v[20:30]  # ties
    v[3] = math.nan
    b, q = frame(spark, v).repartition(3), frame(spark, v[5:17] + 0.5, 1000)
    rows = spark.createDataFrame([(p, o) for p in range(4) for o in (*range(p, 90, p + 2), *range(p, 90, p + 2), 999)], "pred_id int, ordinal long")
    preds = spark.createDataFrame([(1000 + i, None if i == 5 else i % 6) for i in range(12)], "query_id long, pred_id int")
    pairs = rows.join(preds, "pred_id").select("query_id", "ordinal")
    # A similarity below a half is a last bit off where it is published as 1 less its distance.
    got, alike = ([(*x[:3], round(x[3], 12)) for x in df.orderBy("query_id", "rank").collect()] for df in (knn.prefiltered_knn(b, q, rows, 4, metric, mode, preds=preds, plan=plan), knn.prefiltered_knn(b, q, pairs, 4, metric, mode)))
    assert got == alike
    near = {(x.query_id, x.neighbor_id): x for x in knn.knn(b, q, 90, metric, mode, "sql").collect()}
    some = {}
    for x in pairs.distinct().collect():
        if (x.query_id, x.ordinal) in near:
            some.setdefault(x.query_id, []).append(near[x.query_id, x.ordinal])
    want = [(i, x.neighbor_id, r, round(x.distance, 12)) for i in sorted(some) for r, x in enumerate(sorted(some[i], key=lambda x: x.rank)[:4])]
    assert got == want and len(want) == 32
    ground = knn.knn(b, q, 30, metric, mode)
    assert triples(knn.postfiltered_knn(ground, rows, preds)) == triples(knn.postfiltered_knn(ground, pairs))
    explained = [sorted(map(tuple, verify.explain_filtered_knn(ground, knn.prefiltered_knn(b, q, pairs, 4), p, 90, 4, *more).collect()), key=str) for p, more in ((rows.distinct(), (preds,)), (pairs.distinct(), ()))]
    assert explained[0] == explained[1]


def test_pairs_in_many_blocks_of_queries(spark, monkeypatch):
    r = np.random.default_rng(11).normal(size=(60, 3))
    b, q = frame(spark, r), frame(spark, r[:9])
    pairs = spark.createDataFrame([(i, o) for i in range(9) for o in range(i, 60, 2)], "query_id int, ordinal long")
    want = triples(knn.prefiltered_knn(b, q, pairs, 4))
    monkeypatch.setattr(knn, "BLOCK_FLOATS", 6)
    monkeypatch.setattr(knn, "RESCORED", 12)
    assert triples(knn.prefiltered_knn(b, q, pairs, 4)) == want and len(want) == 36


@pytest.mark.parametrize("name", ["prefiltered_knn", "postfiltered_knn", "explain_filtered_knn", "verify_prefiltered", "verify_postfiltered"])
def test_filters_of_a_label_make_no_pairs(spark, name, tmp_path):
    # One label: the pairs that pass are all pairs of a query and a row.
    r = np.random.default_rng(12).normal(size=(1200, 2))
    frame(spark, r).withColumn("label", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    df.collect()
    rows, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        found = p.metrics().get("numOutputRows")
        if found.isDefined():
            rows.append(found.get().value())
    assert 0 < max(rows) < 20_000
