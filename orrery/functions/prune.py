"""Semi-joins by a broadcast of bounded size: what cannot match stays where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, in rows of 64: 131,072 rows, 1 MB of bits, whatever the input. A full filter prunes nothing and loses nothing.
FILTER_BITS = 1 << 23


def _bit(cols: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(1)), F.lit(FILTER_BITS))


def _bits(among: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    rows = among.select(_bit(cols).alias("__bit")).groupBy(F.expr("__bit div 64").alias("__part"))
    return F.broadcast(rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit % 64 as int))")).alias("__bits")))


def _probed(df: DataFrame, among: DataFrame, cols: tuple[str, ...], how: str) -> tuple[DataFrame, Column]:
    rows = df.withColumn("__bit", _bit(cols)).withColumn("__part", F.expr("__bit div 64"))
    return rows.join(_bits(among, cols), "__part", how), F.expr("getbit(__bits, cast(__bit % 64 as int)) = 1")


def marked(df: DataFrame, among: DataFrame, *cols: str, name: str) -> DataFrame:
    """``df`` with a flag: false only where no row of ``among`` has these values of ``cols``."""
    rows, found = _probed(df, among, cols, "left")
    return rows.select(*df.columns, F.coalesce(found, F.lit(False)).alias(name))


def may_match(df: DataFrame, among: DataFrame, *cols: str) -> DataFrame:
    """``df`` without most rows whose values of ``cols`` no row of ``among`` has."""
    rows, found = _probed(df, among, cols, "inner")
    return rows.where(found).select(*df.columns)
