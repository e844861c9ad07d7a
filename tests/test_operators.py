import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators import catalog, extract, hygiene, jq, merkle, stats, survey, synth


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>")


# Clean-up.


def test_zeros_and_duplicates(spark):
    df = vectors(spark, [(1, 2), (1, 2), (0, 0), (3, 4), (0, 0), (5, 6)])
    assert tuple(hygiene.dedup_report(df).first()) == (6, 2, 1, 3)
    assert {r.ordinal: r.first for r in hygiene.dedup_vectors(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 5}
    assert sorted(r[0] for r in hygiene.find_zeros(df).collect()) == [2, 4]
    assert {r.group_size: r.groups for r in hygiene.find_duplicates(df).collect()} == {1: 2, 2: 2}


def test_equality_is_bitwise(spark):
    df = vectors(spark, [(0.0, 1), (-0.0, 1), (math.nan, 1), (math.nan, 1)])
    assert [r.duplicate for r in hygiene.dedup_vectors(df).orderBy("ordinal").collect()] == [False, False, False, True]


@pytest.mark.parametrize("rows", [[], [(1.0, 1.0)] * 5, [(float(i), 0.0) for i in range(9)], [(0.0, 0.0)] * 4, [(5.0,), (3.0,), (4.0,)], [(1.0, 3.0), (1.0, 2.0), (0.0, 9.0), (1.0, 2.0)]])
def test_sort(spark, rows):
    got = [r.ordinal for r in hygiene.sort_vectors(vectors(spark, rows)).orderBy("pos").collect()]
    assert got == [i for _, i in sorted((tuple(r), i) for i, r in enumerate(rows))]


def test_sort_twice_is_the_same(spark):
    df = vectors(spark, np.random.default_rng(0).normal(size=(40, 3)))
    once = hygiene.sort_vectors(df)
    again = once.join(df, once["ordinal"] == df["vec_id"]).select(F.col("pos").alias("vec_id"), "embedding")
    assert all(r.pos == r.ordinal for r in hygiene.sort_vectors(again).collect())


def test_overlap(spark):
    a, b = vectors(spark, [(1, 2), (3, 4), (5, 6)]), vectors(spark, [(3, 4), (7, 8), (5, 6)])
    assert tuple(hygiene.overlap(a, b).first()) == (3, 2, 2 / 3)
    assert [r.vec_id for r in hygiene.remove_overlap(a, b).collect()] == [0]
    assert tuple(hygiene.overlap(a.limit(0), b).first()) == (0, 0, 0.0)


def test_norms(spark):
    df = vectors(spark, [(3, 4), (0, 0)])
    assert [r.embedding for r in hygiene.normalize_vectors(df).orderBy("vec_id").collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert tuple(hygiene.check_normalization(df).first()) == (2, 1, False)
    assert hygiene.remove_zeros(df).count() == 1


def test_shuffle_is_a_seeded_bijection(spark):
    df = spark.range(500).withColumnRenamed("id", "vec_id")
    a, b, c = (sorted(map(tuple, hygiene.shuffle_split(d, 50, s).collect())) for d, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert a == b != c
    assert [x[0] for x in a] == list(range(500)) and sorted(x[1] for x in a) == list(range(500)) and sum(x[2] == "query" for x in a) == 50


def test_repair_and_endianness(spark):
    df = vectors(spark, [(1, 2), (3,), (math.nan, 1), (4, 5)])
    assert sorted(r.vec_id for r in hygiene.repair(df).collect()) == [0, 3]
    assert [hygiene.endianness(x) for x in (b"\x80\0\0\0", b"\0\0\0\x80", b"\0\1\1\0", b"\0\0\0\0")] == ["little", "big", "ambiguous", "invalid"]
    assert sorted(hygiene.mt_permutation(10, 3)) == list(range(10))


# Selection and conversion.


def test_specs(spark):
    df = vectors(spark, [(i,) for i in range(40)])
    assert sorted(r.vec_id for r in extract.select_ordinals(df, "3, 7..9, [20,22), (30,32]").collect()) == [3, 7, 8, 9, 20, 21, 31, 32]
    with pytest.raises(ValueError):
        extract.parse_spec("a..b")
    assert extract.extract_by_range(df, 5, 5).count() == 0 and extract.extract_by_range(df, 38, 99).count() == 2


def test_index_may_repeat(spark):
    df = vectors(spark, [(i,) for i in range(5)])
    index = spark.createDataFrame([(0, 4), (1, 4), (2, 0), (3, 9)], "pos long, ordinal long")
    assert [(r.pos, r.vec_id) for r in extract.extract_by_index(df, index).orderBy("pos").collect()] == [(0, 4), (1, 4), (2, 0)]
    assert [(r.pos, r.vec_id) for r in extract.extract_by_index(df, index, (1, 3)).orderBy("pos").collect()] == [(0, 4), (1, 0)]


def test_clean_ordinals(spark):
    index = spark.createDataFrame([(i, 10 * i) for i in range(6)], "pos long, ordinal long")
    bad = [spark.createDataFrame([(x,) for x in xs], "ordinal long") for xs in ([10, 30], [30, 50])]
    assert sorted(map(tuple, extract.clean_ordinals(index, *bad).collect())) == [(0, 0), (1, 20), (2, 40)]


@pytest.mark.parametrize(("to", "want"), [("u8", [0, 0, 2, 255]), ("i8", [-128, -1, 2, 127]), ("i16", [-300, -1, 2, 1000]), ("u64", [0, 0, 2, 1000]), ("f32", [-300.0, -1.5, 2.5, 1000.0])])
def test_conversion(spark, to, want):
    df = vectors(spark, [(-300, -1.5, 2.5, 1000)])
    got = df.select(vec.converted(vec.doubles("embedding"), to)).first()[0]
    assert [float(x) for x in got] == [float(x) for x in want]


def test_find(spark):
    df = vectors(spark, [(1, 2, 3), (1, 2, 9), (7, 8, 9)])
    assert [tuple(r) for r in extract.find_vector(df, [1, 2, 3]).collect()] == [(0, 3, True), (1, 2, False), (2, 0, False)]


# Statistics.


def test_histogram_of_one_value(spark):
    x = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [tuple(r) for r in stats.histogram(x, 5).collect()] == [(0, 2.0, 2)]


def test_ks_of_equal_and_apart(spark):
    a, b = vectors(spark, [(i,) for i in range(50)]), vectors(spark, [(i + 1000,) for i in range(50)])
    assert tuple(stats.ks_compare(a, a).first()) == (0, 0.0, 1.0)
    d = stats.ks_compare(a, b).first()
    assert d.d == 1.0 and d.p < 1e-6


def test_fit_and_generate_again(spark):
    model = [{"kind": "normal", "mu": 2.0, "sigma": 0.5}, {"kind": "uniform", "lower": -1.0, "upper": 3.0}, {"kind": "beta", "alpha": 2.0, "beta": 5.0, "lower": 0.0, "upper": 1.0}, {"kind": "beta", "alpha": 0.5, "beta": 0.5, "lower": 0.0, "upper": 1.0}]
    df = synth.vectors_from_model(spark, model, 20_000, 3).select(F.col("ordinal").alias("vec_id"), F.col("vec").alias("embedding"))
    got = {r.dim: r for r in stats.fit_model(df, low=0.0, high=1.0).collect()}
    assert abs(got[0].mean - 2) < 0.02 and abs(got[0].std_dev - 0.5) < 0.02 and abs(got[1].mean - 1) < 0.05
    assert got[2].kind == "beta" and abs(got[2].alpha - 2) < 0.2 and abs(got[2].beta - 5) < 0.4
    assert abs(got[3].alpha - 0.5) < 0.05 and got[0].kind == "normal"
    normal = df.select("vec_id", F.slice("embedding", 1, 1).alias("embedding"))
    assert stats.ks_model(normal, stats.fit_model(normal)).first().d < 0.02


def test_beta_cdf():
    assert stats.beta_cdf(1, 1, 0.3) == pytest.approx(0.3) and stats.beta_cdf(2, 2, 0.5) == pytest.approx(0.5) and stats.beta_cdf(2, 5, 0.2) == pytest.approx(0.34464, abs=1e-5)


def test_a_beta_model_is_tested_with_its_own_distribution(spark):
    # Half-arcsine data: the distribution of Beta(1/2, 1/2) is 2/pi asin(sqrt x).
    n = 400
    xs = [math.sin(math.pi / 2 * (i + 0.5) / n) ** 2 for i in range(n)]
    df = spark.createDataFrame([([x, 2 * x - 1],) for x in xs], "embedding array<double>")
    one = df.select(F.slice("embedding", 1, 1).alias("embedding"))
    model = stats.fit_model(one, low=0.0, high=1.0)
    a, b = (getattr(model.first(), k) for k in ("alpha", "beta"))
    want = max(max(abs((i + 1) / n - stats.beta_cdf(a, b, x)), abs(i / n - stats.beta_cdf(a, b, x))) for i, x in enumerate(xs))
    got = stats.ks_model(one, model, low=0.0, high=1.0).first().d
    assert got == pytest.approx(want, abs=1e-9) and got < 0.02
    with pytest.raises(ValueError, match="bounds"):
        stats.ks_model(one, model)
    both = stats.fit_model(df, low=-1.0, high=1.0)
    assert stats.ks_model(df, both, low=-1.0, high=1.0).count() == 2


def test_quantiles_are_values_of_the_table(spark):
    for rows, ps, want in (([1, 2, 2, 3, 10], [0, 0.2, 0.21, 0.6, 1], [1, 1, 2, 2, 10]), ([5], [0.5], [5]), (["b", "a", "c"], [0.34], ["b"])):
        df = spark.createDataFrame([(x,) for x in rows], ["x"])
        assert list(stats.quantiles(df, ps).first()) == want
    assert stats.quantiles(spark.createDataFrame([], "x long"), [0.5]).first()[0] is None


def test_covariance_of_data_far_from_zero(spark):
    import numpy as np

    r = np.random.default_rng(3)
    m = 1e6 + r.normal(size=(200, 3))
    df = spark.createDataFrame([([float(x) for x in v],) for v in m], "embedding array<double>").repartition(5)
    want = np.cov(m.T, bias=True)
    for row in stats.covariance(df).collect():
        assert row.cov == pytest.approx(want[row.i, row.j], abs=1e-6)


def test_pca_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 4)) * [5, 3, 1, 0.1]
    df = vectors(spark, x, "double")
    values, axes = stats.pca_eigen(df)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(values, want)
    p = np.array([r.projection for r in stats.pca_project(df, axes[:2], x.mean(0).tolist()).orderBy("vec_id").collect()])
    assert np.allclose(p.var(0), want[:2])
    s = stats.pca_summary(stats.eigen_frame(df)).first()
    assert s.intrinsic_dim == 3 and s.elbow_95 == 2 and 1 < s.effective_rank < 4


# Survey.


@pytest.mark.parametrize(("probe", "yes", "no"), [
    ("integer", ["5", "+7", "-0"], ["5.0", "", "9" * 30]), ("decimal", ["1.5", ".5", "2."], ["1e5", "1", "."]), ("float", ["1e5", "2.5E-3"], ["1.5", "e5"]), ("boolean", ["TRUE", "n", "0"], ["2", "maybe"]),
    ("uuid", ["01234567-89ab-cdef-0123-456789ABCDEF"], ["01234567-89ab-cdef-0123-456789ABCDEG"]), ("iso_date", ["2024-99-01"], ["2024-1-01"]), ("iso_datetime", ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00"], ["2024-01-01T00:00"]),
    ("email", ["a.b@c.org", "x@a..b"], ["a@b", "@b.c", "a@.b.c", "a b@c.d"]), ("url", ["HTTP://x", "s3://bucket"], ["ftp://x.org", "http://"]), ("ipv4", ["1.2.3.255"], ["1.2.3", "1.2.3.256"]),
    ("ipv6", ["::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::"], ["1:2:3", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9"]), ("phone", ["+1 (555) 123-4567", "2024-01-15"], ["5551234", "+1 555 CALL"]),
    ("geocode", ["90,-180", "1.5, 2"], ["91,0", "1", "a,b"]), ("currency", ["$1,000.50", "€ 5"], ["5$", "$x"]), ("hex", ["0xdeadbeef", "12345678"], ["0xdead", "xyz"]), ("json", ['{"a": 1}', "[1,2]"], ["{a", "5"]),
    ("composite_id", ["USR_00123", "ORD-A12345"], ["U_1", "AB-CDEF", "AB-"]), ("labelset", ["a, b c d", "x,y"], ["a", "a,,b", "a, b c d e"]),
])
def test_probe(spark, probe, yes, no):
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
    got = df.select("t", "want", F.coalesce(survey.TEXT_PROBES[probe](F.trim("t")), F.lit(False)).alias("got")).collect()
    assert [r.t for r in got if r.got != r.want] == []


def test_later_probe_wins(spark):
    df = spark.createDataFrame([("0",), ("1",)], "t string")
    assert [tuple(r) for r in survey.semantic_types(survey.probe_rates(df, ["t"])).collect()] == [("t", "boolean", 1.0)]


@pytest.mark.parametrize(("text", "want"), [("foo123", "A+9+"), ("a@b.com", "A@A.A+"), ("99-99-9999", "9+-9+-9+"), ("a+b++", "A+A++"), ("x  y!?é", "A_+A?+"), ("", "")])
def test_skeleton(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(survey.skeleton(F.col("t"))).first()[0] == want


@pytest.fixture(scope="module")
def people(spark):
    pairs = [("US", "USD"), ("DE", "EUR"), ("JP", "JPY"), ("GB", "GBP"), ("CH", "CHF")]
    return spark.createDataFrame([(i, *pairs[i % 5], i * 0.5 + 1, f"user{i}@example.com") for i in range(200)], "user_id long, country string, currency string, score double, email string")


def test_links_between_fields(people):
    f = survey.functional_dependency(people, "country", "currency").first()
    assert (f.support, f.determinants, f.deterministic) == (1.0, 5, 5)
    assert survey.cramers_v(people, "country", "currency").first().cramers_v > 0.99
    assert survey.pearson(people, "user_id", "score").first().r == pytest.approx(1) and survey.trend(people, "score", "user_id").first().slope == pytest.approx(0.5)
    assert survey.copresence(people, "country", "email").first().jaccard == 1.0
    assert survey.eta_squared(people.limit(1), "country", "score").first().eta_squared is None
    assert survey.pearson(people.withColumn("c", F.lit(1)), "c", "score").first().r is None


def test_plan_and_findings(people):
    import json

    todo = survey.plan(people, ["user_id", "country", "email", "score"])
    assert "frequency" in todo["country"] and "heavy_hitters" in todo["email"] and "bit_width" in todo["user_id"] and "moments" in todo["score"]
    found = {f["field"]: f for f in json.loads(survey.findings(people, ["country", "email"]))["fields"]}
    assert found["email"]["semantic"] == "email" and found["country"]["regime"] == "LowCard"


def test_measures_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(i, 5, None) for i in range(4)], "o long, a int, b string")
    assert survey.bit_width(df, "a").first()["class"] == "Constant"
    m = survey.moments(df, "a").first()
    assert (m.variance, m.skewness, m.excess_kurtosis) == (0.0, 0.0, 0.0)
    assert survey.monotonicity(df, "a", "o").first().level == 3
    assert survey.byte_entropy(df, "b").first()["class"] == "Empty"
    assert survey.magic(F.lit(b"")) is not None
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n"),), (bytearray(b"xy"),)], "b binary")
    assert [r[0] for r in png.select(survey.magic(F.col("b"))).collect()] == ["png", "opaque"]


# Records.


def test_jq(spark):
    lines = ['{"name": "Alice", "age": 30, "tags": ["x", "y"]}', '{"name": "Bob", "age": 25}', "no json", '{"age": "25"}']
    df = spark.createDataFrame([(x,) for x in lines], "j string")

    def run(p):
        return sorted(r.v for r in jq.jq(df, "j", p).collect())

    assert run(".name") == ['"Alice"', '"Bob"'] and run("select(.age > 26) | .name") == ['"Alice"'] and run("length") == ["3"]
    assert run('select(.age == "25") | .age') == ['"25"'] and run("select(.age != 30) | .name") == ['"Bob"'] and run(".tags[]") == ['"x"', '"y"']
    assert run("group_by(.name) | length") == ["3"] and run(".tags | map(.)") == ['["x","y"]'] and len(run(".")) == 3
    with pytest.raises(ValueError):
        jq.jq(df, "j", "a +* b")


def test_catalog_names(spark):
    df = spark.createDataFrame([("Glove-100",), ("sift1m",), ("glove_25",)], "name string")

    def run(p):
        return sorted(r.name for r in df.where(catalog.name_matches(F.col("name"), p)).collect())

    assert run("glove") == ["Glove-100", "glove_25"] and run("glove-*") == ["Glove-100"] and run("/^s.*m$/") == ["sift1m"] and run("sift?m") == ["sift1m"]


def test_merkle_root(spark):
    data = bytes(range(256)) * 10
    leaves = merkle.merkle_chunks(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b""))], "k long, d binary"), "k", "d", 600)

    def fold(h):
        while len(h) > 1:
            h = [hashlib.sha256(h[i] + h[i + 1]).digest() if i + 1 < len(h) else h[i] for i in range(0, len(h), 2)]
        return h[0].hex()

    want = [hashlib.sha256(data[i : i + 600]).digest() for i in range(0, len(data), 600)]
    s = merkle.merkle_summary(leaves).collect()
    assert [(r.key, r.chunks, r.bytes, r.root) for r in s] == [(1, 5, 2560, fold(want))]
    path = merkle.merkle_path(merkle.merkle_levels(leaves), 1, 3).orderBy("level").collect()
    assert [(r.level, r.node) for r in path] == [(0, 3), (1, 1), (2, 0), (3, 0)] and path[-1].hash == fold(want)
    assert sorted((r.chunk, r.change) for r in merkle.merkle_diff(leaves, merkle.spoil(leaves, 2)).collect()) == [(0, "changed"), (2, "changed"), (4, "changed")]


def test_synthetic_predicates_have_their_selectivity(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 97 / 3).alias("x"), F.concat(F.lit("v"), F.col("id") % 7).alias("c"))
    from orrery.functions.predicate import to_column

    for p in synth.numeric_predicates(df, "k", 0.2) + synth.numeric_predicates(df, "x", 0.3):
        assert abs(df.where(to_column(p, df.schema)).count() / 1000 - (0.2 if p.field == "k" else 0.3)) < 0.06
    p = synth.categorical_predicate(df, "c", 0.14)
    assert abs(df.where(to_column(p, df.schema)).count() / 1000 - 0.14) < 0.03
    assert df.where(to_column(synth.reservoir_predicate(df, "c", "k", 1), df.schema)).count() > 0
    t = df.withColumn("t", F.concat("c", F.lit("ab")))
    assert abs(t.where(to_column(synth.trigram_predicate(t, "t", 0.14), t.schema)).count() / 1000 - 0.14) < 0.03


def test_generated_vectors(spark):
    df = synth.generate_vectors(spark, 200, 8, seed=1, normalize=True, zeros=2, duplicates=3)
    rows = {r.ordinal: r.vec for r in df.collect()}
    assert rows[0] == rows[1] == [0.0] * 8 and [rows[i] for i in range(197, 200)] == [rows[i] for i in range(194, 197)]
    assert all(abs(math.hypot(*rows[i]) - 1) < 1e-5 for i in range(2, 200))
    assert {r.ordinal: r.vec for r in synth.generate_vectors(spark, 200, 8, 1, normalize=True, zeros=2, duplicates=3).repartition(3).collect()} == rows
    m = synth.generate_metadata(spark, 2000, {"a": (1, 6)}, 2).agg(F.min("a"), F.max("a"), F.count_distinct("a")).first()
    assert tuple(m) == (1, 6, 6)
    assert synth.sketch_vectors(spark, 10, 6).count() == 10 and synth.simple_predicates(spark, 9, 0, 3).count() == 9


def test_dear_probes_run_only_behind_cheap_ones(spark, monkeypatch):
    # Each costs microseconds a value where it is computed; of these values no one passes what stands before it.
    df = spark.createDataFrame([("plain words",), ("12",), (None,)], "t string")
    dear = F.raise_error
    monkeypatch.setattr(survey.F, "regexp_replace", lambda c, *_: dear(c).cast("string"))
    monkeypatch.setattr(survey.F, "regexp_extract", lambda c, *_: dear(c).cast("string"))
    monkeypatch.setattr(survey.F, "split", lambda c, *_: F.array(dear(c).cast("string")))
    assert {r.probe for r in survey.probe_rates(df, ["t"]).where("rate > 0").collect()} == {"integer"}


PROBED = {
    "ipv6": (["::", "::1", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "1:2:3:4:5:6:10.0.0.1", "fe80::1\n"], ["1:2", "12:30", "::1::2", "::ffff:10.0.0.256", "1:2:3:4:5:6:7:8:9", "g::1", "10.0.0.1"]),
    "ipv4": (["10.0.0.1", "+1.2.3.4"], ["10.0.0.256", "1.2.3", "1.2.3.4.5", "1234"]),
    "phone": (["+1 555 1234", "(030) 123-4567", "2024-01-02", "+123456789012345"], ["5551234", "+1 555 12", "+1234567890123456", "+1 555 1234x"]),
    "composite_id": (["ORD-12", "ab_1x"], ["ORD12", "O-12", "ORD-abc", "ORD-1abc"]),
    "geocode": (["1, 2", "-90,180"], ["91, 2", "1 2", ",", "1,"]),
    "labelset": (["a,b", "red, one two three"], ["a", "a,", "one two three four, b"]),
    "email": (["a@b.c"], ["a@b", "a.b.c"]),
    "decimal": (["1.5", ".5", "1."], ["1", "1.5e3", "1.5.2", "."]),
    "float": (["1e3", "1.5E-2"], ["1.5", "e", "1e"]),
    "iso_date": (["2024-01-02"], ["2024-1-2", "20240102"]),
}


@pytest.mark.parametrize("probe", sorted(PROBED))
def test_probe(spark, probe):
    for values, rate in zip(PROBED[probe], (1.0, 0.0), strict=True):
        for v in values:
            df = spark.createDataFrame([(v,), (None,)], "t string")
            assert survey.probe_rates(df, ["t"]).where(F.col("probe") == probe).first().rate == rate, v


def test_rates_of_a_field_without_values(spark):
    df = spark.createDataFrame([(None, "1", 5), (None, None, None), (None, "x", 7)], "a string, b string, c long")
    got = {(r.field, r.probe): r.rate for r in survey.probe_rates(df, ["a", "b", "c"]).collect()}
    assert len(got) == 2 * len(survey.TEXT_PROBES) + len(survey.NUMBER_PROBES)
    assert {v for (f, _), v in got.items() if f == "a"} == {None} and got["b", "integer"] == 0.5 and got["b", "json"] == 0.0 and got["c", "epoch_seconds"] == 0.0


def test_types_come_from_counts_of_sets_of_probes(spark, sf):
    # One row of a task for each field and set of probes, and no average for each value and probe.
    from orrery.queries.survey import QUERIES

    plan = QUERIES["semantic_types"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in plan and plan.count("count(1)") >= 1
