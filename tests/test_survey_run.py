"""The survey from end to end: classes, chosen measures, pairs, results and the report."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import survey, survey_run


@pytest.fixture(scope="module")
def records(spark):
    k = F.col("id")
    cols = {
        "key": k, "even": k % 2 == 0, "score": (k * 7 % 100).cast("double"), "country": F.when(k % 3 == 0, "fra").when(k % 3 == 1, "deu").otherwise("usa"),
        "currency": F.when(k % 3 == 2, "usd").otherwise("eur"), "mail": F.concat(F.lit("u"), k.cast("string"), F.lit("@example.org")), "tags": F.concat(F.lit("red, x"), (k % 5).cast("string")),
        "seen": F.lit(1_600_000_000) + k, "raw": F.concat(F.lit("ab"), k.cast("string")).cast("binary"), "gap": F.when(k % 4 != 0, k), "at": F.timestamp_seconds(k * 3600), "text": F.concat(F.lit("word "), (k % 90).cast("string"), F.lit(" and more of it")),
        "odd": F.try_parse_json(F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit('"t'), k.cast("string"), F.lit('"')))),
    }
    return spark.range(200).select(*[c.alias(n) for n, c in cols.items()])


@pytest.fixture(scope="module")
def found(records):
    return {f.name: f for f in survey_run.classify(records)}


def test_classes(found):
    assert {n: f.family for n, f in found.items()} == {
        "key": "Number", "even": "Boolean", "score": "Number", "country": "FreeText", "currency": "FreeText", "mail": "Structured", "tags": "Categorical", "seen": "Number", "raw": "Binary",
        "gap": "Number", "at": "Temporal", "text": "FreeText", "odd": "Unstable",
    }
    assert found["even"].regime == "Binary" and found["country"].regime == "LowCard" and found["key"].regime == "MidCard" and found["gap"].present == 150
    assert found["mail"].semantic == "email" and found["tags"].semantic == "labelset" and found["seen"].semantic == "epoch_seconds"


def test_measures_follow_type_and_regime(found):
    m = {n: set(survey_run.measures(f)) for n, f in found.items()}
    assert {"BitWidth", "EpochPlausibility", "HyperLogLog", "HeavyHitters"} <= m["key"] and "DiscreteIndicator" in m["score"] - m["key"]
    assert {"ExactFrequencyTable", "ExactMoments"} <= m["even"] and "ExactFrequencyTable" in m["country"] and "TrigramHeavyHitters" in m["text"]
    assert "LabelsetHeavyHitters" in m["tags"] and "LabelsetHeavyHitters" not in m["text"] and "ByteEntropy" in m["raw"] and "TemporalRange" in m["at"]
    assert m["odd"] == {*survey_run.ALWAYS, *survey_run.UNSTABLE}
    assert all(set(survey_run.ALWAYS) <= x for x in m.values())


def test_pairs_are_ranked_and_bounded(found):
    own = list(found.values())
    todo = survey_run.pairs(own)
    assert not any("odd" in t for t in todo)
    first = next(i for i, t in enumerate(todo) if t[2] != "Copresence")
    assert all(t[2] == "Copresence" for t in todo[:first]) and all(t[2] != "Copresence" for t in todo[first:]) and first == 12 * 11 // 2
    assert ("country", "currency", "FunctionalDependency") in todo and ("currency", "country", "FunctionalDependency") in todo
    assert ("country", "score", "LowCardNumeric") in todo and ("key", survey_run.INDEX, "Trend") in todo and ("key", "score", "NumericCorrelation") in todo
    assert survey_run.pairs(own, 10) == todo[:10]


def test_every_measure_runs(records, found):
    got = survey_run.run(records, "key", ["key", "even", "score", "country", "tags", "raw", "at", "odd"], top=5)
    rows = got.collect()
    of = {}
    for r in rows:
        of.setdefault((r.subject, r.measure), {})[r.item] = r.text if r.value is None else r.value
    for name in ("key", "even", "score", "country", "tags", "raw", "at", "odd"):
        assert {m for s, m in of if s == name} >= set(survey_run.measures(found[name])), name
    assert of["score", "ExactMoments"]["mean"] == 49.5 and of["even", "ExactMoments"]["mean"] == 0.5 and of["odd", "TypeStability"]["types"] == 2
    assert len(of["key", "ReservoirSample"]) == 5 and of["country", "ExactFrequencyTable"]["fra.n"] == 67


def test_report(records):
    got = survey_run.run(records, "key", ["key", "country", "currency", "gap", "seen", "odd"], only={"Presence", "TypeStability", "FunctionalDependency", "EpochPlausibility", "NumericCorrelation"})
    found = json.loads(survey_run.report(got))["findings"]
    said = {(f["severity"], f["subject"], f["other"]): f["finding"] for f in found}
    assert said["alert", "odd", None] == "2 types in one field" and said["warn", "gap", None] == "50 of 200 values are missing"
    assert said["info", "country", "currency"] == "decides the other" and ("info", "currency", "country") not in said and said["info", "seen", None] == "looks like a time since 1970"
    text = survey_run.report(got, "markdown")
    assert text.startswith("# Survey") and "| alert | odd |  | 2 types in one field |" in text
    with pytest.raises(ValueError, match="no report"):
        survey_run.report(got, "xml")


def test_empty_table(records):
    none = records.limit(0).select("key", "country")
    assert survey_run.run(none, "key", only={"Presence"}).where("item = 'records'").count() == 2
    assert survey.probe_rates(none, ["key"]).count() >= 0
