"""A survey from end to end: classify every field, choose measures by what it is and how many values it has, run them, plan and run pairs, report.

Classification is one pass of aggregates whose result has a row per field; all that is chosen from it is
driver-side bookkeeping. Every measure is a plan of its own over the columns that it needs, and all results
are rows of one shape: (subject, other, measure, item, value, text).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import stats, survey

#: The second axis of a trend.
INDEX = "__record_index__"
SCHEMA = "subject string, other string, measure string, item string, value double, text string"

#: What a probe's verdict is an instance of.
FAMILIES = {
    "integer": "Number", "decimal": "Number", "float": "Number", "boolean": "Boolean", "epoch_millis": "Temporal", "epoch_seconds": "Temporal", "iso_date": "Temporal", "iso_datetime": "Temporal",
    "uuid": "Identifier", "hex": "Identifier", "composite_id": "Identifier", "email": "Structured", "url": "Structured", "ipv4": "Structured", "ipv6": "Structured", "phone": "Structured",
    "geocode": "Structured", "currency": "Structured", "json": "Structured", "labelset": "Categorical",
}
#: Measures of any field, of a family, and of a cardinality regime.
ALWAYS = ("Presence", "TypeStability", "ReservoirSample")
UNSTABLE = ("WireEncodingHistogram", "ByteOrCharLengthRange", "ProbeAttempt")
NUMERIC = ("ExactExtrema", "ExactMoments", "QuantileSketch", "HistogramFromQuantiles", "Monotonicity")
SHAPE = ("ExactLengthMoments", "LengthQuantiles", "CharClassMix", "PatternSkeleton")
BY_REGIME = {
    "Constant": ("ExactFrequencyTable",), "Binary": ("ExactFrequencyTable",), "LowCard": ("ExactFrequencyTable",),
    "MidCard": ("HyperLogLog", "HeavyHitters"), "HighCardOrUnique": ("HyperLogLog",),
}
#: How telling a field of a regime is, for the order of pairs.
TELLING = {"HighCardOrUnique": 1.0, "MidCard": 0.75, "LowCard": 0.5, "Binary": 0.25, "Constant": 0.0}


@dataclass(frozen=True)
class Field:
    """What the first pass says of a field."""

    name: str
    encoding: str
    semantic: str | None
    family: str
    regime: str
    records: int
    present: int
    kind: T.DataType

    @property
    def numeric(self) -> bool:
        """Whether its values are measured as numbers: numbers by type, and booleans as 0 and 1."""
        return self.family in ("Number", "Boolean") and self.encoding in ("Numeric", "Bool")

    @property
    def low_card(self) -> bool:
        return self.regime in ("Constant", "Binary", "LowCard")


def _family(kind: T.DataType, encoding: str, semantic: str | None) -> str:
    if isinstance(kind, T.VariantType):
        return "Unstable"
    if isinstance(kind, T.DatetimeType):
        return "Temporal"
    if encoding == "Textual":
        return FAMILIES.get(semantic or "", "FreeText")
    return {"Bool": "Boolean", "Numeric": "Number", "Bytes": "Binary", "Null": "Null"}.get(encoding, "Structured")


def classify(df: DataFrame, fields: list[str] | None = None, threshold: float = survey.RATE, exact: bool = True) -> list[Field]:
    """Every field's encoding, semantic type and cardinality regime."""
    fields = fields or [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.NullType))]
    plain = [f for f in fields if not isinstance(df.schema[f].dataType, T.VariantType)]
    here = {r["field"]: r for r in survey.presence(df, fields).collect()}
    kinds = {r["field"]: r["probe"] for r in survey.semantic_types(survey.probe_rates(df, plain), threshold).collect()}
    regimes = {r["field"]: r["regime"] for r in survey.cardinality(df, plain, exact).collect()} if plain else {}
    out = []
    for f in fields:
        kind, enc = df.schema[f].dataType, here[f]["encoding"]
        family = _family(kind, enc, kinds.get(f))
        out.append(Field(f, enc, kinds.get(f), family, regimes.get(f, "Constant"), here[f]["records"], here[f]["present"], kind))
    return out


def measures(f: Field) -> list[str]:
    """The measures that a field gets, in their order."""
    if f.family == "Unstable":
        return [*ALWAYS, *UNSTABLE]
    out = list(ALWAYS)
    if f.numeric:
        out += NUMERIC
        if isinstance(f.kind, T.IntegralType):
            out += ["BitWidth", "EpochPlausibility"]
        if isinstance(f.kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            out += ["DiscreteIndicator"]
    if isinstance(f.kind, T.DatetimeType):
        out += ["TemporalRange"]
    if f.family == "Binary":
        out += ["ByteEntropy"]
    if f.encoding == "Textual":
        out += SHAPE
        if f.family in ("FreeText", "Structured", "Categorical"):
            out += ["TrigramHeavyHitters"]
        if f.semantic == "labelset":
            out += ["LabelsetHeavyHitters"]
    return [*out, *BY_REGIME[f.regime]]


def pairs(fields: list[Field], most: int = 1024) -> list[tuple[str, str, str]]:
    """(a, b, measure) in the order of their worth: co-presence of all pairs first, then by the less telling field; the rank list ends at ``most``."""
    own, todo = [f for f in fields if f.family != "Unstable"], []
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            rank = min(TELLING[a.regime], TELLING[b.regime])
            found = ["Copresence"]
            found += ["NumericCorrelation"] * (a.numeric and b.numeric) + ["CategoricalAssociation"] * (a.low_card and b.low_card)
            todo += [(m != "Copresence", -rank, (a.name, b.name, m)) for m in found]
            if a.low_card and b.numeric or a.numeric and b.low_card:
                group, value = (a, b) if a.low_card and b.numeric else (b, a)
                todo.append((True, -rank, (group.name, value.name, "LowCardNumeric")))
            todo += [(True, -rank, (x.name, y.name, "FunctionalDependency")) for x, y in ((a, b), (b, a)) if x.low_card]
    todo += [(True, -TELLING[f.regime], (f.name, INDEX, "Trend")) for f in own if f.numeric]
    return [x for _, _, x in sorted(todo, key=lambda t: t[:2])[:most]]


def _rows(result: DataFrame, subject: str, other: str | None, measure: str, key: str | None = None) -> DataFrame:
    """A measure's table as rows of the common shape; of tables with several rows, ``key`` names an item."""
    cells = []
    for f in result.schema:
        if f.name == key:
            continue
        name = F.lit(f.name) if key is None else F.concat(F.col(key).cast("string"), F.lit("." + f.name))
        number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        value = F.col(f.name).cast("double") if number else F.lit(None).cast("double")
        cells.append(F.struct(name.alias("item"), value.alias("value"), (F.lit(None) if number else F.col(f.name)).cast("string").alias("text")))
    rows = result.select(F.explode(F.array(*cells)).alias("c"))
    return rows.select(F.lit(subject).alias("subject"), F.lit(other).cast("string").alias("other"), F.lit(measure).alias("measure"), "c.item", "c.value", "c.text")


def _stability(df: DataFrame, f: Field) -> DataFrame:
    """The type of a typed column never changes; of a VARIANT one, the number of its types tells."""
    tag = F.schema_of_variant(f.name) if isinstance(f.kind, T.VariantType) else F.lit(f.kind.simpleString())
    n = df.where(F.col(f.name).isNotNull()).groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("types"), (F.count(F.lit(1)) <= 1).alias("stable"))


def _tags(df: DataFrame, f: Field) -> DataFrame:
    return df.groupBy(F.coalesce(F.schema_of_variant(f.name), F.lit("ABSENT")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _text(f: Field) -> Column:
    return F.to_json(f.name) if isinstance(f.kind, T.VariantType) else F.col(f.name).cast("string")


def _length_range(df: DataFrame, f: Field) -> DataFrame:
    n = F.char_length(_text(f))
    return df.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"))


def _attempts(df: DataFrame, f: Field) -> DataFrame:
    """The share of values that each probe of texts accepts, of values as they are written."""
    v = F.trim(F.regexp_replace(_text(f), '^"|"$', ""))
    rows = df.where(F.col(f.name).isNotNull()).select(v.alias("v"))
    rates = rows.agg(*[F.avg(F.coalesce(t(F.col("v")), F.lit(False)).cast("double")).alias(k) for k, t in survey.TEXT_PROBES.items()])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.col(k).alias("rate")) for k in survey.TEXT_PROBES])).alias("r")).select("r.*")


def _numbers(df: DataFrame, f: Field) -> DataFrame:
    """The field as a number; booleans as 0 and 1."""
    return df.withColumn(f.name, F.col(f.name).cast("int")) if isinstance(f.kind, T.BooleanType) else df


def _run(df: DataFrame, f: Field, measure: str, ordinal: str, top: int) -> DataFrame:
    """One measure of one field."""
    c, x = f.name, _numbers(df, f)
    runs: dict[str, tuple[Callable[[], DataFrame], str | None]] = {
        "Presence": (lambda: survey.presence(df, [c]).select("records", "present", "nulls"), None),
        "TypeStability": (lambda: _stability(df, f), None),
        "ReservoirSample": (lambda: survey.sample(df.where(F.col(c).isNotNull()), top, ordinal).select(F.col(ordinal).cast("string").alias("key"), _text(f).alias("sampled")), "key"),
        "WireEncodingHistogram": (lambda: _tags(df, f), "tag"),
        "ByteOrCharLengthRange": (lambda: _length_range(df, f), None),
        "ProbeAttempt": (lambda: _attempts(df, f), "probe"),
        "ExactExtrema": (lambda: survey.moments(x, c).select("min", "max"), None),
        "ExactMoments": (lambda: survey.moments(x, c).drop("min", "max"), None),
        "QuantileSketch": (lambda: survey.quantiles(x, c), "p"),
        "HistogramFromQuantiles": (lambda: stats.histogram(x.select(F.col(c).cast("double").alias("x")), 32), "bin"),
        "Monotonicity": (lambda: survey.monotonicity(x, c, ordinal), None),
        "BitWidth": (lambda: survey.bit_width(x, c), None),
        "EpochPlausibility": (lambda: survey.epoch(x, c), None),
        "DiscreteIndicator": (lambda: survey.discrete_share(x, c), None),
        "TemporalRange": (lambda: survey.temporal(df, c), None),
        "ByteEntropy": (lambda: survey.byte_entropy(df, c), None),
        "ExactLengthMoments": (lambda: survey.lengths(df, c).select("unit", "count", "min", "max", "mean", "variance"), "unit"),
        "LengthQuantiles": (lambda: survey.lengths(df, c).select("unit", *[f"p{p}" for p in survey.QUANTILES]), "unit"),
        "CharClassMix": (lambda: survey.char_mix(df, c), None),
        "PatternSkeleton": (lambda: survey.skeletons(df, c, top), "pattern"),
        "TrigramHeavyHitters": (lambda: survey.trigrams(df, c, 1024), "trigram"),
        "LabelsetHeavyHitters": (lambda: survey.labels(df, c, top), "label"),
        "ExactFrequencyTable": (lambda: survey.frequency(df, c), "value"),
        "HyperLogLog": (lambda: survey.hll(df.withColumn(c, F.col(c).cast("string")), c), None),
        "HeavyHitters": (lambda: survey.heavy_hitters(df, c, top), "value"),
    }
    make, key = runs[measure]
    return _rows(make(), c, None, measure, key)


def _pair(df: DataFrame, a: str, b: str, measure: str, ordinal: str, fields: dict[str, Field]) -> DataFrame:
    for n in (a, b):
        df = _numbers(df, fields[n]) if n in fields and measure != "CategoricalAssociation" else df
    runs = {
        "Copresence": lambda: survey.copresence(df, a, b),
        "NumericCorrelation": lambda: survey.pearson(df, a, b),
        "CategoricalAssociation": lambda: survey.cramers_v(df, a, b),
        "LowCardNumeric": lambda: survey.eta_squared(df, a, b),
        "FunctionalDependency": lambda: survey.functional_dependency(df, a, b),
        "Trend": lambda: survey.trend(df, a, ordinal),
    }
    return _rows(runs[measure](), a, b, measure)


def plan(df: DataFrame, ordinal: str, fields: list[str] | None = None, most: int = 1024) -> DataFrame:
    """(subject, other, measure, semantic, family, regime) of everything that a survey of the table would run."""
    found = classify(df, fields)
    rows = [(f.name, None, m, f.semantic, f.family, f.regime) for f in found for m in measures(f)]
    rows += [(a, b, m, None, None, None) for a, b, m in pairs(found, most)]
    return df.sparkSession.createDataFrame(rows, "subject string, other string, measure string, semantic string, family string, regime string")


def run(df: DataFrame, ordinal: str, fields: list[str] | None = None, most: int = 1024, top: int = 64, only: set[str] | None = None) -> DataFrame:
    """(subject, other, measure, item, value, text): the whole survey, or the measures in ``only``."""
    found = classify(df, fields)
    names = {f.name: f for f in found}
    parts = [_run(df, f, m, ordinal, top) for f in found for m in measures(f) if only is None or m in only]
    parts += [_pair(df, a, b, m, ordinal, names) for a, b, m in pairs(found, most) if only is None or m in only]
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out


def findings(result: DataFrame) -> list[dict]:
    """What a reader should see first, from a survey's rows: (severity, subject, other, finding)."""
    by: dict[tuple, dict] = {}
    for r in result.where(~F.col("measure").isin("TrigramHeavyHitters", "ReservoirSample", "HistogramFromQuantiles")).collect():  # bounded tables alone
        by.setdefault((r.subject, r.other, r.measure), {})[r.item] = r.text if r.value is None else r.value
    out = []

    def say(severity: str, key: tuple, text: str) -> None:
        out.append({"severity": severity, "subject": key[0], "other": key[1], "finding": text})

    for key, v in by.items():
        if key[2] == "Presence" and v["nulls"]:
            say("warn" if v["nulls"] * 2 < v["records"] else "alert", key, f"{v['nulls']:.0f} of {v['records']:.0f} values are missing")
        if key[2] == "TypeStability" and not v["stable"]:
            say("alert", key, f"{v['types']:.0f} types in one field")
        if key[2] == "ExactFrequencyTable" and len([i for i in v if i.endswith(".n")]) == 1:
            say("info", key, "one value only")
        if key[2] == "NumericCorrelation" and v["r"] is not None and abs(v["r"]) >= 0.9:
            say("info", key, f"correlated, r = {v['r']:.3f}")
        if key[2] == "CategoricalAssociation" and v["cramers_v"] is not None and v["cramers_v"] >= 0.5:
            say("info", key, f"associated, V = {v['cramers_v']:.3f}")
        if key[2] == "FunctionalDependency" and v["support"] == 1.0 and v["determinants"] > 1:
            say("info", key, "decides the other")
        if key[2] == "EpochPlausibility" and max(v["seconds_share"] or 0, v["millis_share"] or 0) >= survey.RATE:
            say("info", key, "looks like a time since 1970")
    order = {"alert": 0, "warn": 1, "info": 2}
    return sorted(out, key=lambda f: (order[f["severity"]], f["subject"], f["other"] or "", f["finding"]))


def report(result: DataFrame, form: str = "json") -> str:
    """The findings as JSON or Markdown."""
    rows = findings(result)
    if form == "json":
        return json.dumps({"findings": rows}, indent=2)
    if form != "markdown":
        raise ValueError(f"no report in the form {form!r}")
    lines = ["# Survey", "", "| Severity | Field | With | Finding |", "|-|-|-|-|"]
    return "\n".join([*lines, *(f"| {r['severity']} | {r['subject']} | {r['other'] or ''} | {r['finding']} |" for r in rows)]) + "\n"
