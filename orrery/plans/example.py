"""A whole synthetic data set: vectors, metadata, predicates, their results, neighbours with and without filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import hygiene, knn, predicates, synth, verify
from orrery.plans.dataset import Dataset
from orrery.plans.pipeline import Pipeline, Step


def _vectors(spark: SparkSession, n: int, dim: int, seed: int) -> DataFrame:
    v = synth.generate_vectors(spark, n, dim, seed, normalize=True)
    return v.select("ordinal", F.col("vec").alias("embedding"))


def _metadata(spark: SparkSession, n: int, top: int, seed: int) -> DataFrame:
    return synth.generate_metadata(spark, n, {"value": (0, top)}, seed)


def _predicates(spark: SparkSession, n: int, top: int, seed: int) -> DataFrame:
    return synth.simple_predicates(spark, n, 0, top, seed)


def _results(spark: SparkSession, metadata: DataFrame, preds: DataFrame) -> DataFrame:
    return predicates.evaluate_int_eq(metadata, preds, ["value"], ["value"], "ordinal").select(F.col("pred_id").cast("long").alias("query_id"), "ordinal")


def _knn(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return knn.knn(base, queries, k, id_col="ordinal")


def _pre(spark: SparkSession, base: DataFrame, queries: DataFrame, results: DataFrame, k: int) -> DataFrame:
    return knn.prefiltered_knn(base, queries, results, k, id_col="ordinal")


def _post(spark: SparkSession, ground: DataFrame, results: DataFrame) -> DataFrame:
    return knn.postfiltered_knn(ground, results)


def steps(n: int = 1000, n_queries: int = 100, dim: int = 128, k: int = 100, top: int = 12, seed: int = 42) -> list[Step]:
    return [
        Step("base_vectors", _vectors, options={"n": n, "dim": dim, "seed": seed}),
        Step("query_vectors", _vectors, options={"n": n_queries, "dim": dim, "seed": seed + 1}),
        Step("metadata_content", _metadata, options={"n": n, "top": top, "seed": seed}),
        Step("metadata_predicates", _predicates, options={"n": n_queries, "top": top, "seed": seed + 2}),
        Step("predicate_results", _results, {"metadata": "metadata_content", "preds": "metadata_predicates"}),
        Step("neighbor_indices", _knn, {"base": "base_vectors", "queries": "query_vectors"}, options={"k": k}),
        Step("prefiltered_neighbors", _pre, {"base": "base_vectors", "queries": "query_vectors", "results": "predicate_results"}, options={"k": k}),
        Step("postfiltered_neighbors", _post, {"ground": "neighbor_indices", "results": "predicate_results"}),
    ]


def example_dataset(spark: SparkSession, folder: str, **options: int) -> tuple[Dataset, dict[str, DataFrame]]:
    """Made, or found as it was made before, under a folder."""
    p = Pipeline(spark, folder)
    out = p.run(steps(**options))
    marks = {e["step"]: e["provenance"] for e in p.log}
    facets = {s: f"{folder.rstrip('/')}/{s}-{marks[s]}" for s in out}
    return Dataset("example", {"default": facets}), out


def verify_dataset(facets: dict[str, DataFrame], k: int) -> DataFrame:
    """(check, ok): dimensions and norms, no duplicates, no overlap, neighbours as the other plan finds them, filters within their results."""
    b, q, g, r = (facets[f] for f in ("base_vectors", "query_vectors", "neighbor_indices", "predicate_results"))
    again = verify.summary(verify.knn_compare(g, knn.knn(b, q, k, id_col="ordinal", plan="sql")))
    pre = facets["prefiltered_neighbors"].join(r.withColumnRenamed("ordinal", "neighbor_id"), ["query_id", "neighbor_id"], "left_anti")
    post = verify.summary(verify.knn_compare(facets["postfiltered_neighbors"], knn.postfiltered_knn(g, r)))
    rows = [
        ("normalized", hygiene.check_normalization(b).first()["normalized"]),
        ("duplicates", hygiene.dedup_report(b, "ordinal").first()["duplicates"] == 0),
        ("overlap", hygiene.overlap(q, b).first()["shared"] == 0),
        ("neighbors", [x["verdict"] for x in again.collect()] == ["exact"]),
        ("prefiltered", pre.isEmpty()),
        ("postfiltered", {x["verdict"] for x in post.collect()} <= {"exact"}),
    ]
    return b.sparkSession.createDataFrame(rows, "check string, ok boolean")
