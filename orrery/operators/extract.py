"""Selection and conversion by ordinal. An ordinal is a column, never a row's place in a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.session import cut


def parse_spec(spec: str) -> list[tuple[int, int]]:
    """Closed ranges of a spec such as ``3,7,10..19,[20,25)``; a bare m..n includes n."""
    import re

    out = []
    for part in re.findall(r"[\[(][^\])]*[\])]|[^,]+", spec.replace(" ", "")):
        if not part.strip(","):
            continue
        if m := re.fullmatch(r"([\[(])(\d+),(\d+)([\])])", part):
            out.append((int(m[2]) + (m[1] == "("), int(m[3]) - (m[4] == ")")))
        elif m := re.fullmatch(r"(\d+)\.\.(\d+)", part):
            out.append((int(m[1]), int(m[2])))
        elif part.isdigit():
            out.append((int(part), int(part)))
        else:
            raise ValueError(f"cannot read {part!r} in the ordinal spec {spec!r}")
    return out


def in_spec(ordinal: Column, spec: str) -> Column:
    """Whether an ordinal is in a spec; plain comparisons, so that the scan can skip row groups."""
    out = F.lit(False)
    for low, high in parse_spec(spec):
        out = out | ((ordinal == low) if low == high else ordinal.between(low, high))
    return out


def select_ordinals(df: DataFrame, spec: str, id_col: str = "vec_id") -> DataFrame:
    return df.where(in_spec(F.col(id_col), spec))


def slice_vectors(df: DataFrame, first: int, last: int, start: int, length: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Ordinals first to last, both included, and ``length`` components from ``start`` (from 0)."""
    return df.where(F.col(id_col).between(first, last)).select(id_col, F.slice(vec_col, start + 1, length).alias(vec_col))


def extract_by_index(df: DataFrame, index: DataFrame, window: tuple[int, int] | None = None, id_col: str = "vec_id") -> DataFrame:
    """Rows in the order of an index (pos, ordinal), with ``pos`` counted anew from the window's start; an ordinal may come again."""
    if window:
        index = index.where((F.col("pos") >= window[0]) & (F.col("pos") < window[1])).withColumn("pos", F.col("pos") - window[0])
    return index.join(df, index["ordinal"] == df[id_col]).drop("ordinal")


def extract_by_range(df: DataFrame, low: int, high: int, id_col: str = "vec_id") -> DataFrame:
    """Ordinals low to high, high excluded, with ``pos`` from 0; a range beyond the end gives what there is."""
    return df.where((F.col(id_col) >= low) & (F.col(id_col) < high)).withColumn("pos", F.col(id_col) - low)


def extract_by_predicate(df: DataFrame, results: DataFrame, pred_id: int, id_col: str = "vec_id") -> DataFrame:
    """Rows that one predicate's results (pred_id, ordinal) name."""
    own = results.where(F.col("pred_id") == pred_id).select("ordinal").distinct()
    return df.join(own, df[id_col] == own["ordinal"], "left_semi")


def clean_ordinals(ordered: DataFrame, *excluded: DataFrame) -> DataFrame:
    """(pos, ordinal): an ordered index without the ordinals of the exclusion lists, ranked anew.

    See dense_positions(): no task holds the whole index.
    """
    left = ordered
    for e in excluded:
        left = left.join(e.select("ordinal").distinct(), "ordinal", "left_anti")
    return dense_positions(left, ["pos"]).select("pos", "ordinal")


def dense_positions(df: DataFrame, order: list[str], out: str = "pos", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df``, less the columns ``drop``, with a gapless place from 0 in the order of the columns.

    One range shuffle, whose sampled bounds take all order columns into account, and a sort within
    each range; a row's place there and the number of its range are one id, kept by being written.
    What is added afterwards is the sizes of the ranges before: one number per task. No task sees the
    whole table, and nothing but those numbers is gathered.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(rows.drop(*drop), "placed").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # A row per range, which is a row per shuffle partition.
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_id", "_part", "_at", "_before")


def running_sums(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """``df`` with sums from the start of each group to the row, in the order of ``order``.

    Rows are dealt out by ranges of group and order, so that a large group is many tasks; a task's
    sums start from those of the group's earlier ranges. Rows of equal order are in any order. A row whose group is
    null is left out.
    """
    rows = df.repartitionByRange(*by, *order).withColumns({"_part": F.spark_partition_id(), **{f"_{k}": v for k, v in sums.items()}})
    placed = cut(rows, "ranges")
    per = placed.groupBy("_part", *by).agg(*[F.sum(f"_{k}").alias(f"_{k}_own") for k in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *by, *[F.coalesce(F.sum(f"_{k}_own").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums])
    w = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({k: F.sum(f"_{k}").over(w) for k in sums})
    out = inner.join(offsets, ["_part", *by]).withColumns({k: F.col(k) + F.col(f"_{k}_before") for k in sums})
    return out.drop("_part", *[f"_{k}" for k in sums], *[f"_{k}_before" for k in sums])


def find_vector(df: DataFrame, example: list[float], limit: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, matching, exact): the rows that share most components with an example, exact ones first."""
    probe = F.array(*[F.lit(float(x)) for x in example])
    same = F.size(F.filter(F.zip_with(vec.doubles(vec_col), probe, lambda a, b: a == b), lambda x: x))
    exact = (same == len(example)) & (F.size(vec_col) == len(example))
    rows = df.select(F.col(id_col), same.alias("matching"), exact.alias("exact"))
    return rows.orderBy(F.desc("exact"), F.desc("matching"), id_col).limit(limit)


def convert_elements(df: DataFrame, to: str, normalize: bool = False, scale: float = 1.0, vec_col: str = "embedding") -> DataFrame:
    """Vectors with elements of another type, first normalised if asked for, then scaled."""
    v = vec.normalized(F.col(vec_col), "double") if normalize else vec.doubles(vec_col)
    return df.withColumn(vec_col, vec.converted(F.transform(v, lambda x: x * scale), to))


def describe_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(element, count, min_dim, max_dim, nulls)."""
    element = df.schema[vec_col].dataType.elementType.simpleString()
    return df.agg(F.lit(element).alias("element"), F.count(F.lit(1)).alias("count"), F.min(F.size(vec_col)).alias("min_dim"), F.max(F.size(vec_col)).alias("max_dim"), F.count_if(F.col(vec_col).isNull()).alias("nulls"))
