"""Record stores: import, export, append, compaction, checks and inspection of slab files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.extract import dense_positions
from orrery.session import map_arrow
from orrery.sources import formats


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, ordinal, payload) from the lines of text or JSONL files, in order of file and place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.encode("value", "utf-8").alias("payload"))
    return dense_positions(lines, ["_at"], "ordinal").select(F.lit(1).alias("namespace"), "ordinal", "payload")


def save(records: DataFrame, path: str, page_size: int = formats.PAGE, files: int | None = None) -> None:
    """Write records as slab files, ordinals rising from file to file."""
    n = files or records.sparkSession.sparkContext.defaultParallelism
    rows = records.repartitionByRange(n, "ordinal").sortWithinPartitions("ordinal")
    rows.write.format("slab").option("page_size", page_size).mode("append").save(path)


def load(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records of slab files; a range of ordinals prunes pages."""
    reader = spark.read.format("slab")
    if first is not None:
        reader = reader.option("first", first)
    if last is not None:
        reader = reader.option("last", last)
    return reader.load(path)


def get(spark: SparkSession, path: str, ordinal: int) -> bytes | None:
    """One record, from the page that holds it."""
    row = load(spark, path, ordinal, ordinal).first()
    return bytes(row["payload"]) if row else None


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new records after the old ones, their ordinals moved to follow."""
    end = (old.agg(F.max("ordinal")).first()[0] or -1) + 1 if not old.isEmpty() else 0
    low = new.agg(F.min("ordinal")).first()[0] or 0
    return old.unionByName(new.withColumn("ordinal", F.col("ordinal") - low + end))


def export_text(records: DataFrame, style: str = "text") -> DataFrame:
    """(ordinal, value): payloads as text, hex, or JSON objects of ordinal and text."""
    text = F.decode("payload", "utf-8")
    value = {"text": text, "hex": F.lower(F.hex("payload")), "json": F.to_json(F.struct("ordinal", text.alias("payload")))}[style]
    return records.select("ordinal", value.alias("value"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, offset, size, namespace): the page table."""
    rows = [(p, *page) for p, _ in formats.listing(path) for page in formats.slab_index(p)]
    return spark.createDataFrame(rows, "file string, first bigint, offset bigint, size bigint, namespace int")


def check(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, problem): pages that cannot be read, or whose ordinals run into the next page of their file."""
    table = pages(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            after, problem = [], []
            for file, first, offset, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    with formats._open(file) as f:
                        f.seek(offset)
                        after.append(first + len(formats.slab_records(f.read(size))))
                    problem.append("")
                except ValueError as e:
                    after.append(first)
                    problem.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(after, pa.int64()), pa.array(problem, pa.string())], names=["file", "offset", "first", "after", "problem"])

    found = map_arrow(table.repartition(max(1, min(table.count(), 1000))), run, "file string, offset bigint, first bigint, after bigint, problem string")
    # The next larger first ordinal of the file: a page reaches no further.
    following = F.min("first").over(Window.partitionBy("file").orderBy("first").rangeBetween(1, Window.unboundedFollowing))
    said = F.when(F.col("problem") != "", F.col("problem")).when(F.col("following") < F.col("after"), "ordinals run into another page")
    return found.withColumn("following", following).select("file", "offset", said.alias("problem")).where("problem IS NOT NULL")


def rewrite(spark: SparkSession, path: str, to: str, page_size: int = formats.PAGE) -> None:
    """Records of live pages, paged anew."""
    save(load(spark, path), to, page_size)


def namespaces(records: DataFrame) -> DataFrame:
    """(namespace, records)."""
    return records.groupBy("namespace").agg(F.count(F.lit(1)).alias("records"))
