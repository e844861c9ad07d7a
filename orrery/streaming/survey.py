"""The survey over streams: measures that merge, kept per field and window, and updated as records come.

Sketches and sums of a micro-batch are aggregated first and then merged into what a folder holds, so a
batch that is written twice after a failure replaces itself: its part is named by the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial(df: DataFrame, field: str) -> DataFrame:
    """One row of mergeable parts: counts, sums, extremes, and a distinct-count sketch."""
    x = F.col(field).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count(field).alias("present"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.hll_sketch_agg(F.col(field).cast("string"), 12).alias("hll"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """(records, present, mean, variance, min, max, distinct) of any number of parts."""
    n = F.sum("present")
    mean = F.sum("sum") / n
    return parts.agg(
        F.sum("records").alias("records"), n.alias("present"), mean.alias("mean"), (F.sum("sum_sq") / n - mean * mean).alias("variance"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"),
    )


def start(stream: DataFrame, field: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a field's parts under ``folder``, one per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch, field).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, field: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, records, mean, min, max) per tumbling window; records later than ``late`` are left out."""
    x = F.col(field).cast("double")
    out = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("records"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), "records", "mean", "min", "max")
