from pyspark.sql import functions as F

from orrery.streaming import survey


def test_parts_merge_to_the_whole(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 700).alias("x"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for i in range(3):
        df.where(F.col("x") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = survey.start(stream, "x", f"{tmp_path}/parts", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = survey.merged(spark.read.parquet(f"{tmp_path}/parts")).first()
    want = df.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    assert (got.records, got.present, got.min, got.max) == (3000, 3000, 0.0, 699.0)
    assert abs(got.mean - want.m) < 1e-9 and abs(got.variance - want.v) < 1e-6 and abs(got.distinct - 700) < 40


def test_windows(spark, tmp_path):
    df = spark.range(600).select(F.col("id").alias("x"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = survey.windowed(stream, "ts", "x").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("SELECT records, min, max FROM hours ORDER BY min").collect()
    assert len(rows) == 10 and all(r.records == 60 and r.max - r.min == 59 for r in rows)
