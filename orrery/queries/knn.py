"""Nearest neighbours over ``embeddings``: every row whose id is divisible by 20 is a query, all rows are the base.

A query finds itself first: it is a row of the base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import knn, verify
from orrery.session import table

K = 10
#: Rungs of the ladder of sizes below the whole base.
SIZES = [50, 120, 300]


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e, e.where("vec_id % 20 = 0")


def passing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(pred_id, ordinal), the base rows that have each label, and (query_id, pred_id), the label that a query asks for: two tables of rows, not of pairs."""
    b, q = sides(spark, sf)
    return b.select(F.col("label").alias("pred_id"), F.col("vec_id").alias("ordinal")), q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("pred_id"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("distance",)})


def _metric(metric: str, mode: str | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b, q = sides(spark, sf)
        return rounded(knn.knn(b, q, K, metric, mode))

    return run


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    return rounded(knn.knn_distances(knn.knn(b, q, K), b, q, "L1"))


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    # Components cut to a few levels, so that there are ties.
    b, q = (x.withColumn("embedding", F.transform("embedding", lambda v: F.round(v * 2).cast("float"))) for x in sides(spark, sf))
    return knn.knn_ties(b, q, K)


def _pre(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    rows, preds = passing(spark, sf)
    return rounded(knn.prefiltered_knn(b, q, rows, K, preds=preds))


def _post(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    return knn.postfiltered_knn(knn.knn(b, q, 50), *passing(spark, sf))


def _partitioned(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    return rounded(knn.partitioned_knn(b, q, K))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    n = b.count()
    return rounded(knn.sized_knn(b, q, sorted({*[x for x in SIZES if x < n], n}), K))


def _spoiled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The true neighbours, and the same with faults: query 20 swaps two, 40 loses three, 60 loses all but two."""
    b, q = sides(spark, sf)
    truth = knn.knn(b, q, K)
    bad = truth.withColumn("rank", F.when((F.col("query_id") == 20) & (F.col("rank") < 2), 1 - F.col("rank")).otherwise(F.col("rank")))
    gone = ((F.col("query_id") == 40) & (F.col("rank") >= 7)) | ((F.col("query_id") == 60) & (F.col("rank") >= 2))
    return truth, bad.withColumn("neighbor_id", F.when(gone, -1 - F.col("neighbor_id")).otherwise(F.col("neighbor_id")))


def _compare(spark: SparkSession, sf: str) -> DataFrame:
    return verify.knn_compare(*_spoiled(spark, sf))


def _verify(spark: SparkSession, sf: str) -> DataFrame:
    truth, bad = _spoiled(spark, sf)
    return rounded(verify.recall(truth, bad), "recall")


def _verify_pre(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among the rows that pass, by direct sums of every pair, beside those that the tiles find within a label."""
    b, q = sides(spark, sf)
    rows, preds = passing(spark, sf)
    return verify.summary(verify.knn_compare(knn.prefiltered_knn(b, q, rows, K, preds=preds, plan="direct"), knn.partitioned_knn(b, q, K)))


def _verify_post(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by the tiles and filtered by tables, beside those that the direct sums find and whose labels are equal."""
    b, q = sides(spark, sf)
    direct = knn.knn(b, q, 50, plan="direct").join(q.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    direct = direct.join(b.select(F.col("vec_id").alias("neighbor_id"), "label"), ["neighbor_id", "label"])
    return verify.summary(verify.knn_compare(direct, knn.postfiltered_knn(knn.knn(b, q, 50), *passing(spark, sf))))


def _parity(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    out = None
    for metric, mode in (("L2", None), ("DOT", None), ("L1", None), ("COSINE", "proper")):
        part = verify.summary(verify.knn_compare(knn.knn(b, q, K, metric, mode, "direct"), knn.knn(b, q, K, metric, mode, "blocks"))).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


def _explain(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    return rounded(verify.explain_knn(knn.knn(b, q, K), knn.knn(b, q, K, plan="sql"), 140), "distance", "recomputed_distance")


def _explain_filtered(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    rows, preds = passing(spark, sf)
    out = verify.explain_filtered_knn(knn.knn(b, q, 50), knn.prefiltered_knn(b, q, rows, 50, preds=preds), rows, b.count(), 50, preds)
    return rounded(out, "selectivity", "recall", "mean_rank_shift")


def _explain_partition(spark: SparkSession, sf: str) -> DataFrame:
    b, q = sides(spark, sf)
    return verify.explain_partition(knn.partition_profiles(b), knn.partitioned_knn(b, q, K), 100)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return knn.partition_profiles(sides(spark, sf)[0], least=K)


QUERIES = {
    "knn_l2": _metric("L2"),
    "knn_dot": _metric("DOT_PRODUCT"),
    "knn_cosine": _metric("COSINE", "proper"),
    "knn_l1": _metric("L1"),
    "knn_ties": _ties,
    "knn_distances": _distances,
    "prefiltered_knn": _pre,
    "postfiltered_knn": _post,
    "partition_profiles": _profiles,
    "partitioned_knn": _partitioned,
    "sized_profile_knn": _sized,
    "knn_compare": _compare,
    "verify_knn": _verify,
    "verify_prefiltered": _verify_pre,
    "verify_postfiltered": _verify_post,
    "engine_parity": _parity,
    "explain_knn": _explain,
    "explain_filtered_knn": _explain_filtered,
    "explain_partition": _explain_partition,
}

_BQ = "b AS (SELECT vec_id, label, embedding AS v FROM embeddings), q AS (SELECT * FROM b WHERE vec_id % 20 = 0)"
_ZIP = "list_sum(list_transform(list_zip(q.v, b.v), lambda p: {}))"
_D = {
    "L2": _ZIP.format("(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)"),
    "L1": _ZIP.format("abs(p[1]::DOUBLE - p[2]::DOUBLE)"),
    "DOT": _ZIP.format("p[1]::DOUBLE * p[2]::DOUBLE"),
}
_N = "sqrt(list_sum(list_transform({0}.v, lambda x: x::DOUBLE * x::DOUBLE)))"
_D["COSINE"] = f"{_D['DOT']} / ({_N.format('q')} * {_N.format('b')})"


def _ranked(metric: str, k: int, where: str = "", more: str = "") -> str:
    sign = "DESC" if metric in ("DOT", "COSINE") else "ASC"
    return f"""d AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, q.label AS label, {_D[metric]} AS distance FROM q, b {where}),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {sign}, neighbor_id) - 1 AS rank FROM d QUALIFY rank < {k}){more}"""


def _top(metric: str) -> str:
    return f"WITH {_BQ}, {_ranked(metric, K)} SELECT query_id, neighbor_id, rank::INT AS rank, round(distance, 6) AS distance FROM g"


_F = f"""d0 AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, q.label = b.label AS same, {_D['L2']} AS distance FROM q, b),
f AS (SELECT query_id, neighbor_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) - 1 AS rank FROM d0 WHERE same QUALIFY rank < 50)"""

ORACLES = {
    "knn_l2": _top("L2"),
    "knn_dot": _top("DOT"),
    "knn_cosine": _top("COSINE"),
    "knn_l1": _top("L1"),
    "knn_ties": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::FLOAT * 2::FLOAT)::FLOAT) AS v FROM embeddings),
b AS (SELECT * FROM e), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query_id, {_D['L2']} AS distance FROM q, b),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY distance) AS r FROM d QUALIFY r <= {K}),
m AS (SELECT query_id, count(*) AS n, max(distance) AS far FROM r GROUP BY 1),
t AS (SELECT r.query_id, count(*) AS tied FROM r JOIN m USING (query_id) WHERE n > {K} AND distance = far GROUP BY 1)
SELECT q.vec_id AS query_id, coalesce(tied, 0) AS tied_neighbors FROM q LEFT JOIN t ON t.query_id = q.vec_id""",
    "knn_distances": f"""WITH {_BQ}, {_ranked('L2', K)}
SELECT query_id, rank::INT AS rank, neighbor_id, round({_D['L1']}, 6) AS distance FROM g JOIN q ON q.vec_id = query_id JOIN b ON b.vec_id = neighbor_id""",
    "prefiltered_knn": f"WITH {_BQ}, {_ranked('L2', K, 'WHERE q.label = b.label')} SELECT query_id, neighbor_id, rank::INT AS rank, round(distance, 6) AS distance FROM g",
    "postfiltered_knn": f"""WITH {_BQ}, {_ranked('L2', 50)}
SELECT query_id, neighbor_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INT AS rank FROM g JOIN b ON b.vec_id = neighbor_id AND b.label = g.label""",
    "partition_profiles": f"SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal, vec_id AS id FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) >= {K}",
    "partitioned_knn": f"WITH {_BQ}, {_ranked('L2', K, 'WHERE q.label = b.label')} SELECT label, query_id, neighbor_id, rank::INT AS rank, round(distance, 6) AS distance FROM g",
    "sized_profile_knn": f"""WITH {_BQ}, s AS (SELECT DISTINCT least(unnest({SIZES} || [(SELECT count(*) FROM embeddings)::INT]), (SELECT count(*) FROM embeddings))::INT AS size),
d AS (SELECT size, q.vec_id AS query_id, b.vec_id AS neighbor_id, {_D['L2']} AS distance FROM q, b, s WHERE b.vec_id < size)
SELECT size, query_id, neighbor_id, (row_number() OVER (PARTITION BY size, query_id ORDER BY distance, neighbor_id) - 1)::INT AS rank, round(distance, 6) AS distance FROM d QUALIFY rank < {K}""",
    "knn_compare": f"SELECT vec_id AS query_id, CASE vec_id WHEN 20 THEN 'set' WHEN 40 THEN 'boundary' WHEN 60 THEN 'boundary' ELSE 'exact' END AS verdict, (CASE vec_id WHEN 40 THEN 2 WHEN 60 THEN 4 ELSE 0 END)::INT AS differing FROM embeddings WHERE vec_id % 20 = 0",
    "verify_knn": f"SELECT vec_id AS query_id, (CASE vec_id WHEN 40 THEN 7 WHEN 60 THEN 2 ELSE {K} END)::BIGINT AS found, {K}::BIGINT AS wanted, CASE vec_id WHEN 40 THEN 0.7 WHEN 60 THEN 0.2 ELSE 1.0 END::DOUBLE AS recall FROM embeddings WHERE vec_id % 20 = 0",
    "verify_prefiltered": f"SELECT 'exact' AS verdict, count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0",
    "verify_postfiltered": f"WITH {_BQ}, {_ranked('L2', 50)} SELECT 'exact' AS verdict, count(DISTINCT query_id) AS queries FROM g JOIN b ON b.vec_id = neighbor_id AND b.label = g.label",
    "engine_parity": f"SELECT unnest(['L2', 'DOT', 'L1', 'COSINE']) AS metric, 'exact' AS verdict, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries",
    "explain_knn": f"WITH {_BQ}, {_ranked('L2', K)} SELECT rank::INT AS rank, neighbor_id, round(distance, 6) AS distance, neighbor_id AS recomputed_id, round(distance, 6) AS recomputed_distance, true AS same FROM g WHERE query_id = 140",
    "explain_filtered_knn": f"""WITH {_BQ}, {_ranked('L2', 50)}, {_F},
j AS (SELECT coalesce(g.query_id, f.query_id) AS query_id, g.rank AS gr, f.rank AS fr FROM g FULL JOIN f ON g.query_id = f.query_id AND g.neighbor_id = f.neighbor_id)
SELECT query_id, round((SELECT count(*) FROM b JOIN q ON b.label = q.label WHERE q.vec_id = query_id) / (SELECT count(*) FROM b), 6) AS selectivity,
count(*) FILTER (gr IS NOT NULL AND fr IS NOT NULL) AS shared, round(count(*) FILTER (gr IS NOT NULL AND fr IS NOT NULL) / 50, 6) AS recall,
round(avg(abs(fr - gr)), 6) AS mean_rank_shift, count(*) FILTER (gr IS NULL) AS fresh FROM j GROUP BY query_id""",
    "explain_partition": f"""WITH {_BQ}, {_ranked('L2', K, 'WHERE q.label = b.label')}, p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal, vec_id FROM b)
SELECT rank::INT AS rank, neighbor_id, p.label, ordinal FROM g JOIN p ON p.vec_id = neighbor_id WHERE query_id = 100""",
}
