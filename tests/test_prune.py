"""The bounded filter never loses a match and carries whatever columns there are."""

from pyspark.sql import functions as F

from orrery.functions.prune import marked, may_match


def test_no_match_is_lost(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("bit"), F.lit("x").alias("part"), F.lit(None).cast("string").alias("bits"))
    among = spark.range(0, 5000, 50).select(F.col("id").alias("k"))
    got = may_match(df, among, "k")
    assert got.columns == df.columns
    assert {r.k for r in among.collect()} <= {r.k for r in got.collect()} and got.count() < 150
    flagged = marked(df, among, "k", name="maybe")
    assert flagged.count() == 5000 and flagged.where("maybe").count() == got.count()


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (1,)], "k long")
    assert may_match(df, df.limit(0), "k").count() == 0 and marked(df, df.limit(0), "k", name="m").where("NOT m").count() == 2
    assert may_match(df, df, "k").count() == 2
