"""Verification: result sets compared row by row, engines compared with each other, traces of single queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many exchanged neighbours still count as a matter of ties at the boundary.
BOUNDARY = 5


def as_sets(neighbors: DataFrame) -> DataFrame:
    """(query_id, ids): neighbour ids in rank order, negatives dropped."""
    rows = neighbors.where("neighbor_id >= 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))).alias("r"))
    return rows.select("query_id", F.col("r.neighbor_id").alias("ids"))


def knn_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(query_id, verdict, differing): exact (same order), set (same ids), boundary (BOUNDARY or fewer exchanged) or real."""
    a, b = as_sets(expected).withColumnRenamed("ids", "a"), as_sets(actual).withColumnRenamed("ids", "b")
    both = a.join(b, "query_id", "full").withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in "ab"})
    apart = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    differing = F.ceil(apart / 2).cast("int")
    verdict = F.when(F.col("a") == F.col("b"), "exact").when(apart == 0, "set").when(differing <= BOUNDARY, "boundary").otherwise("real")
    return both.select("query_id", verdict.alias("verdict"), differing.alias("differing"))


def recall(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(query_id, found, wanted, recall) of the expected neighbours among the actual ones."""
    want = expected.where("neighbor_id >= 0").select("query_id", "neighbor_id")
    got = actual.select("query_id", "neighbor_id", F.lit(1).alias("hit"))
    n = want.join(got, ["query_id", "neighbor_id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))
    return n.withColumn("recall", F.col("found") / F.col("wanted"))


def summary(compared: DataFrame) -> DataFrame:
    """(verdict, queries) of a comparison."""
    return compared.groupBy("verdict").agg(F.count(F.lit(1)).alias("queries"))


def explain_knn(ground: DataFrame, recomputed: DataFrame, query_id: int) -> DataFrame:
    """(rank, neighbor_id, distance, recomputed_id, recomputed_distance, same) of one query."""
    g = ground.where(F.col("query_id") == query_id).select("rank", "neighbor_id", "distance")
    r = recomputed.where(F.col("query_id") == query_id).select("rank", F.col("neighbor_id").alias("recomputed_id"), F.col("distance").alias("recomputed_distance"))
    return g.join(r, "rank", "full").withColumn("same", F.col("neighbor_id").eqNullSafe(F.col("recomputed_id")))


def explain_filtered_knn(ground: DataFrame, filtered: DataFrame, passing: DataFrame, n_base: int, k: int, preds: DataFrame | None = None) -> DataFrame:
    """(query_id, selectivity, shared, recall, mean_rank_shift, fresh) of filtered neighbours against unfiltered ones.

    The shift is that of shared neighbours; fresh ones are in the filtered result alone. ``passing`` is (query_id, ordinal),
    or (pred_id, ordinal) where ``preds`` has each query's (query_id, pred_id).
    """
    g = ground.select("query_id", "neighbor_id", F.col("rank").alias("g_rank"))
    f = filtered.select("query_id", "neighbor_id", F.col("rank").alias("f_rank"))
    both = g.join(f, ["query_id", "neighbor_id"], "full")
    shared = F.col("g_rank").isNotNull() & F.col("f_rank").isNotNull()
    per = both.groupBy("query_id").agg(
        F.count_if(shared).alias("shared"),
        F.avg(F.when(shared, F.abs(F.col("f_rank") - F.col("g_rank")))).alias("mean_rank_shift"),
        F.count_if(F.col("g_rank").isNull()).alias("fresh"),
    )
    by = "query_id" if preds is None else "pred_id"
    sel = passing.groupBy(by).agg((F.count(F.lit(1)) / n_base).alias("selectivity"))
    sel = sel if preds is None else preds.select("query_id", "pred_id").join(sel, "pred_id")
    out = per.join(sel, "query_id", "left")
    return out.select("query_id", F.coalesce("selectivity", F.lit(0.0)).alias("selectivity"), "shared", (F.col("shared") / k).alias("recall"), "mean_rank_shift", "fresh")


def shift_histogram(ground: DataFrame, filtered: DataFrame) -> DataFrame:
    """(bin, n): absolute rank shifts of shared neighbours, in bins of 1, or of a fiftieth of the largest shift from 50 on."""
    f = filtered.select("query_id", "neighbor_id", F.col("rank").alias("f_rank"))
    d = ground.join(f, ["query_id", "neighbor_id"]).select(F.abs(F.col("f_rank") - F.col("rank")).alias("d"))
    top = d.agg(F.max("d").alias("top"))
    width = F.when(F.col("top") < 50, 1.0).otherwise(F.col("top") / 50)
    return d.crossJoin(F.broadcast(top)).groupBy(F.floor(F.col("d") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def explain_partition(profiles: DataFrame, neighbors: DataFrame, query_id: int) -> DataFrame:
    """(rank, neighbor_id, label, ordinal): one query's neighbours with their place in their partition."""
    own = neighbors.where(F.col("query_id") == query_id).select("rank", "neighbor_id")
    return own.join(profiles, own["neighbor_id"] == profiles["id"], "left").select("rank", "neighbor_id", "label", "ordinal")


def first_ranks(neighbors: DataFrame, k: int) -> DataFrame:
    """The first k ranks of each query, ranked anew from 0."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return neighbors.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)
