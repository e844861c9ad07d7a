"""Clean-up of vector sets: duplicates, zeros, norms, overlap, shuffles.

Equality is bitwise where vectors are grouped: -0.0 differs from 0.0, and NaNs equal each other.
Grouping is by a digest of the vector; counts are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.extract import dense_positions
from orrery.operators.stats import percentiles

NEAR_ZERO = 1e-6


def keyed(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """With ``_key``: the SHA-256 of a vector's bits, 32 bytes that move in its place."""
    return df.withColumn("_key", F.unhex(F.sha2(vec.bits(F.col(vec_col)), 256)))


def sort_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(pos, ordinal): places in lexicographic order of components, equal vectors by ordinal.

    A sampled range sort deals the rows out; vectors stop moving once their rows are in order.
    """
    rows = df.select(F.col(id_col).alias("ordinal"), F.col(vec_col).alias("_v"))
    return dense_positions(rows, ["_v", "ordinal"], drop=("_v",)).select("pos", "ordinal")


def dedup_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(ordinal, first, duplicate): the smallest ordinal with the same vector, and whether the row is another."""
    rows = keyed(df, vec_col).select(F.col(id_col).alias("ordinal"), F.xxhash64("_key").alias("_h"), "_key")
    first = rows.groupBy("_h", "_key").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = rows.join(first, ["_h", "_key"], "left").select("ordinal", F.coalesce("first", "ordinal").alias("first"))
    return out.withColumn("duplicate", F.col("ordinal") != F.col("first"))


def is_near_zero(v: Column, threshold: float = NEAR_ZERO) -> Column:
    return vec.total(F.transform(vec.doubles(v), lambda x: x * x)) < threshold * threshold


def dedup_report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(total, zeros, duplicates, unique): zero vectors are counted apart from duplicates."""
    rows = keyed(df, vec_col).withColumn("_zero", F.forall(vec_col, lambda x: x == 0))
    groups = rows.groupBy(F.xxhash64("_key").alias("_h"), "_key", "_zero").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("_zero"), F.col("n"))), F.lit(0)).alias("zeros"),
        F.coalesce(F.sum(F.when(~F.col("_zero"), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(~F.col("_zero")).alias("unique"),
    )


def find_duplicates(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(group_size, groups): how many vectors occur how often."""
    sizes = keyed(df, vec_col).groupBy(F.xxhash64("_key").alias("_h"), "_key").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))


def find_zeros(df: DataFrame, threshold: float = NEAR_ZERO, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(ordinal) of vectors whose norm is under the threshold."""
    return df.where(is_near_zero(F.col(vec_col), threshold)).select(F.col(id_col).alias("ordinal"))


def zeros_summary(df: DataFrame, threshold: float = NEAR_ZERO, vec_col: str = "embedding") -> DataFrame:
    """(total, exact_zeros, near_zeros)."""
    zero = F.forall(vec_col, lambda x: x == 0)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(zero).alias("exact_zeros"), F.count_if(is_near_zero(F.col(vec_col), threshold)).alias("near_zeros"))


def measure_normals(df: DataFrame, epsilon: float = 2.0**-23, vec_col: str = "embedding") -> DataFrame:
    """Deviation of norms from 1: mean, min, max, stddev (population), median, and whether the mean is under ten epsilons times the root of the dimension."""
    rows = df.select(F.abs(vec.norm(F.col(vec_col)) - 1).alias("e"), F.size(vec_col).alias("dim"))
    out = rows.agg(F.count(F.lit(1)).alias("count"), F.avg("e").alias("mean"), F.min("e").alias("min"), F.max("e").alias("max"), F.stddev_pop("e").alias("stddev"), F.max("dim").alias("dim"))
    # The median is looked up by place: the built-in one would hold every norm in one task.
    out = out.crossJoin(F.broadcast(percentiles(rows.select(F.col("e").alias("x")), [50]).toDF("median")))
    return out.select("count", "mean", "min", "max", "stddev", "median", "dim", (F.col("mean") < 10 * epsilon * F.sqrt("dim")).alias("is_normalized"))


def check_normalization(df: DataFrame, tolerance: float = 1e-3, vec_col: str = "embedding") -> DataFrame:
    """(total, zeros, normalized): all norms within the tolerance of 1."""
    ok = F.abs(vec.norm(F.col(vec_col)) - 1) < tolerance
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.forall(vec_col, lambda x: x == 0)).alias("zeros"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("normalized"))


def fvecs_check(df: DataFrame, tolerance: float = 1e-5, vec_col: str = "embedding") -> DataFrame:
    """(magnitude, n): how many deviations of the norm from 1 lie at each power of ten; -99 for none at all."""
    e = F.abs(vec.norm(F.col(vec_col)) - 1)
    size = F.when(e < 1e-12, -99).otherwise(F.floor(F.log10(e))).cast("int")
    return df.select(size.alias("magnitude"), (e < tolerance).alias("ok")).groupBy("magnitude").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("within"))


def normalize_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn(vec_col, vec.normalized(F.col(vec_col), df.schema[vec_col].dataType.elementType.simpleString()))


def remove_zeros(df: DataFrame, threshold: float = NEAR_ZERO, vec_col: str = "embedding") -> DataFrame:
    return df.where(~is_near_zero(F.col(vec_col), threshold))


def _same(a: DataFrame, b: DataFrame, vec_col: str, how: str) -> DataFrame:
    keys = keyed(b, vec_col).select("_key").distinct()
    return keyed(a, vec_col).join(keys, "_key", how).drop("_key")


def overlap(queries: DataFrame, base: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(queries, shared, fraction): query vectors that are in the base, by the vectors themselves."""
    shared = _same(queries, base, vec_col, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    n = queries.agg(F.count(F.lit(1)).alias("queries"))
    return n.crossJoin(shared).withColumn("fraction", F.when(F.col("queries") == 0, 0.0).otherwise(F.col("shared") / F.col("queries")))


def remove_overlap(queries: DataFrame, base: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return _same(queries, base, vec_col, "left_anti")


def shuffle_split(df: DataFrame, n_queries: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """(pos, ordinal, part): a seeded permutation of the ordinals; the first ``n_queries`` places are the query part."""
    rows = df.select(F.col(id_col).alias("ordinal")).withColumn("_h", F.xxhash64(F.lit(seed), "ordinal"))
    out = dense_positions(rows, ["_h", "ordinal"]).select("pos", "ordinal")
    return out.withColumn("part", F.when(F.col("pos") < n_queries, "query").otherwise("base"))


def mt_permutation(n: int, seed: int) -> list[int]:
    """The permutation of numpy's legacy generator, for data sets that were split with it."""
    import numpy as np

    return np.random.RandomState(seed).permutation(n).tolist()


def repair(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector has the most common dimension and finite components alone."""
    dims = df.groupBy(F.size(vec_col).alias("_dim")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_dim").limit(1).select("_dim")
    finite = F.forall(vec.doubles(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.join(F.broadcast(dims), F.size(vec_col) == F.col("_dim"), "left_semi").where(finite)


def endianness(header: bytes) -> str:
    """little, big, ambiguous or invalid: how the dimension in a vector file's first four bytes can be read."""
    little, big = (int.from_bytes(header[:4], o, signed=True) for o in ("little", "big"))
    ok = [0 < x <= 1_000_000 for x in (little, big)]
    return "ambiguous" if all(ok) else "little" if ok[0] else "big" if ok[1] else "invalid"


def numbered(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """A gapless ordinal from 0 in the order of columns."""
    return dense_positions(df, order, out)


def group_positions(df: DataFrame, by: str, order: str) -> DataFrame:
    """With ``pos``: the place of a row in its group."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("bigint"))
