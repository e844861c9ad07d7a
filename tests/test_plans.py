import pytest
from pyspark.sql import functions as F

from orrery.plans import notation as N
from orrery.plans.dataset import Dataset, catalog
from orrery.plans.pipeline import Pipeline, Step, order


@pytest.mark.parametrize(("text", "n"), [("1000", 1000), ("10k", 10_000), ("1_000", 1000), ("2gi", 2**31), ("64KiB", 65_536), ("1.5m", 1_500_000), ("1g24m", 1_024_000_000), ("118MB", 118_000_000)])
def test_count(text, n):
    assert N.count(text) == n


@pytest.mark.parametrize("text", ["", "k", "10q", "1 2", "-3"])
def test_no_count(text):
    with pytest.raises(ValueError):
        N.count(text)


@pytest.mark.parametrize(("text", "want"), [("[0,10)", [(0, 10)]), ("(0,10]", [(1, 11)]), ("0..1k", [(0, 1000)]), ("..5", [(0, 5)]), ("7..", [(7, N.OPEN_END)]), ("3", [(3, 4)]), ("[0..5),[10..12]", [(0, 5), (10, 13)])])
def test_windows(text, want):
    assert N.windows(text) == want


@pytest.mark.parametrize(("text", "base", "want"), [
    ("10k", 0, [10_000]), ("10k", 5000, []), ("step:1k..5k/2k", 0, [1000, 3000, 5000]), ("parts:0..10/4", 0, [2, 5, 7, 10]), ("fib:1000..5000", 0, [1000, 2000, 3000, 5000]),
    ("mul:10..100/2", 0, [10, 20, 40, 80]), ("linear:100/100", 350, [100, 200, 300]), ("decade", 5000, [10, 100, 1000]), ("0..400k/10", 0, [i * 40_000 for i in range(1, 11)]), ("1m..3m/1m", 2_500_000, [1_000_000, 2_000_000]),
])
def test_strata(text, base, want):
    assert N.strata(text, base) == want


@pytest.mark.parametrize("text", ["fib:0..5", "mul:1..9/1", "step:1..9/0", "linear:5/5", "what:1..2/3"])
def test_wrong_strata(text):
    with pytest.raises(ValueError):
        N.strata(text)


def test_source():
    assert N.source("base.fvec[0..100)") == ("base.fvec", None, "[0..100)")
    assert N.source("s3://b/x.slab:meta[3,9)") == ("s3://b/x.slab", "meta", "[3,9)")
    assert N.source("x.npy") == ("x.npy", None, None)


def test_window_reaches_the_scan(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "ordinal").write.parquet(f"{tmp_path}/b.parquet")
    d = Dataset("d", {"default": {"base_vectors": "b.parquet"}}, str(tmp_path)).sized("parts:0..400/4", 1000)
    assert set(d.profiles) == {"default", "100", "200", "300", "400"}
    df = d.facet(spark, "B", "300")
    assert df.count() == 300 and d.facet(spark, "B").count() == 1000
    assert "PushedFilters: [IsNotNull(ordinal), GreaterThanOrEqual(ordinal,0), LessThan(ordinal,300)]" in df._jdf.queryExecution().toString()
    own = d.derive(spark, "200", f"{tmp_path}/own")
    assert own.facet(spark, "base_vectors").count() == 200
    assert catalog(spark, [d, own]).count() == 6
    with pytest.raises(KeyError):
        d.facet(spark, "Q")


def test_order():
    s = [Step("c", None, {"x": "b"}), Step("a", None), Step("b", None, after=["a"])]
    assert [x.id for x in order(s)] == ["a", "b", "c"]
    for bad in ([Step("a", None), Step("a", None)], [Step("a", None, after=["z"])], [Step("a", None, after=["b"]), Step("b", None, after=["a"])]):
        with pytest.raises(ValueError):
            order(bad)


def make(spark, n):
    return spark.range(n)


def double(spark, rows, by):
    return rows.select((F.col("id") * by).alias("id"))


def test_pipeline_skips_what_is_unchanged(spark, tmp_path):
    def steps(by):
        return [Step("twice", double, {"rows": "base"}, options={"by": by}), Step("base", make, options={"n": 5})]

    p = Pipeline(spark, str(tmp_path))
    assert sorted(r.id for r in p.run(steps(2))["twice"].collect()) == [0, 2, 4, 6, 8] and p.ran == ["base", "twice"]
    p = Pipeline(spark, str(tmp_path))
    p.run(steps(2))
    assert p.ran == []
    p.run(steps(3))
    assert p.ran == ["twice"]


def test_pipeline_grows_from_data(spark, tmp_path):
    def per_value(df):
        return [Step(f"part-{r.id}", double, {"rows": "base"}, options={"by": r.id}) for r in df.collect()]

    out = Pipeline(spark, str(tmp_path)).run([Step("base", make, options={"n": 3}, expand=per_value)])
    assert set(out) == {"base", "part-0", "part-1", "part-2"}
