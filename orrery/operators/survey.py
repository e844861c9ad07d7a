"""Survey of metadata: what each field is, and measures of its values.

Classification runs all probes of a field in one pass. Measures are plain aggregations: exact where
the counterpart is bounded by a sketch, with the sketch beside it for very large inputs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.stats import percentiles

LOW, MID, RATE = 64, 4096, 0.95
#: 2000-01-01 and 2100-01-01, in seconds.
EPOCH_LOW, EPOCH_HIGH = 946_684_800, 4_102_444_800
_FLOAT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _number(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), c.try_cast("double"))


def _has(c: Column, *any_of: str) -> Column:
    return reduce(or_, [c.contains(x) for x in any_of])


def _only(gate: Column, test: Column) -> Column:
    """A dear test behind a cheap one, which all that passes it has passed.

    Not by AND: what a plan has twice on the right of an AND is computed for every row before.
    """
    return F.when(gate, test).otherwise(F.lit(False))


def _octets(c: Column) -> Column:
    dotted = _only(_has(c, "."), c.rlike(r"^([+]?[0-9]+[.]){3}[+]?[0-9]+$"))
    return _only(dotted, F.forall(F.split(c, "[.]"), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))))


def _ipv6(c: Column) -> Column:
    """Eight groups of up to four hex digits, one run of them replaced by ::, the last two perhaps as an IPv4 address."""
    v4 = F.regexp_extract(c, r":([0-9]+(?:[.][0-9]+){3})$", 1)
    s = F.when(~_has(c, "."), c).when(v4 == "", c).when(_octets(v4), F.regexp_replace(c, r"[0-9]+([.][0-9]+){3}$", "0:0")).otherwise(F.lit("x"))
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
    shape = s.rlike(r"^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?(::([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?)?$") & s.contains(":")
    plain = _only(_has(c, ":"), ~c.rlike(r"[^0-9a-fA-F:.\r\n\x{85}\x{2028}\x{2029}]"))
    return _only(plain, shape & F.when(s.contains("::"), groups <= 7).otherwise(groups == 8))


def _phone(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return _only(_only(_has(c, "+", "(", "-"), ~c.rlike("[A-Za-z]")), digits.isin(*range(7, 16)))


def _geocode(c: Column) -> Column:
    comma = F.instr(c, ",")
    lat, lng = _number(F.trim(F.substring_index(c, ",", 1))), _number(F.trim(F.substr(c, comma + 1)))
    return _only(_has(c, ","), lat.between(-90, 90) & lng.between(-180, 180))


def _composite(c: Column) -> Column:
    body = F.regexp_extract(c, r"^[A-Za-z]{2,}[_-]([A-Za-z0-9]+)$", 1)
    return _only(_has(c, "_", "-"), (body != "") & (F.length(F.regexp_replace(body, "[^0-9]", "")) * 2 >= F.length(body)))


def is_labelset(c: Column) -> Column:
    """At least two chunks between commas, each of one to three words."""
    return _only(_has(c, ","), c.rlike(r"^\s*[^\s,]+(\s+[^\s,]+){0,2}\s*(,\s*[^\s,]+(\s+[^\s,]+){0,2}\s*)+$"))


#: Text probes in the suite's order; of equal rates the later one wins.
TEXT_PROBES: dict[str, Callable[[Column], Column]] = {
    "integer": lambda c: _only(c.rlike("^[+-]?[0-9]+$"), c.try_cast("bigint").isNotNull()),
    "decimal": lambda c: _only(_has(c, ".") & ~_has(c, "e", "E"), c.rlike(_FLOAT)),
    "float": lambda c: _only(_has(c, "e", "E"), c.rlike(_FLOAT)),
    "boolean": lambda c: F.lower(c).isin("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"),
    "uuid": lambda c: _only(_has(c, "-"), c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
    "iso_date": lambda c: _only(_has(c, "-"), c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
    "iso_datetime": lambda c: (F.octet_length(c) >= 19) & c.rlike("^.{4}-.{2}-.{2}[T ].{2}:.{2}:.{2}"),
    "email": lambda c: _only(_has(c, "@"), F.length(c).between(3, 254) & c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*[.][A-Za-z0-9.-]*[A-Za-z0-9-]$")),
    "url": lambda c: (F.octet_length(c) >= 8) & F.lower(c).rlike(r"^(http|https|s3|file)://.") ,
    "ipv4": _octets,
    "ipv6": _ipv6,
    "phone": _phone,
    "geocode": _geocode,
    "currency": lambda c: _only(c.rlike("^[$€£¥]"), _number(F.replace(F.trim(F.substr(c, F.lit(2))), F.lit(","), F.lit(""))).isNotNull()),
    "hex": lambda c: c.rlike("^(0[xX])?[0-9a-fA-F]{8,}$"),
    "json": lambda c: _only(c.rlike(r"^[{\[]"), F.try_parse_json(c).isNotNull()),
    "composite_id": _composite,
    "labelset": is_labelset,
}
NUMBER_PROBES: dict[str, Callable[[Column], Column]] = {
    "epoch_millis": lambda c: (c >= EPOCH_LOW * 1000) & (c < EPOCH_HIGH * 1000),
    "epoch_seconds": lambda c: (c >= EPOCH_LOW) & (c < EPOCH_HIGH),
}
#: The first bytes of known formats, in hex.
MAGIC = {"png": "89504E47", "gzip": "1F8B", "parquet": "50415231", "jpeg": "FFD8FF", "zip": "504B0304", "zstd": "28B52FFD"}


def magic(c: Column) -> Column:
    """The format that a byte string begins as; opaque if none or too short."""
    head, out = F.hex(F.substring(c, 1, 8)), F.lit("opaque")
    for name, start in MAGIC.items():
        out = F.when(head.startswith(start) & (F.octet_length(c) >= 4), name).otherwise(out)
    return out


def encoding(kind: T.DataType) -> str:
    """The wire encoding of a field's type."""
    if isinstance(kind, T.BooleanType):
        return "Bool"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "Textual"
    if isinstance(kind, (T.NumericType, T.DatetimeType)):
        return "Numeric"
    if isinstance(kind, T.BinaryType):
        return "Bytes"
    return "Null" if isinstance(kind, T.NullType) else "Collection"


def probe_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, probe, position, rate): the share of non-null values that each probe of a field accepts.

    Fields of one kind are stacked, so that the plan has a suite's probes once and not once per field. Values are
    counted by field and by which probes accept them, so each probe is a column of its own, compiled on its own, and
    a task hands on a row for each set of probes that occurs.
    """
    out = df.sparkSession.createDataFrame([], "field string, probe string, position int, rate double")
    text = [f for f in fields if encoding(df.schema[f].dataType) == "Textual"]
    whole = [f for f in fields if isinstance(df.schema[f].dataType, T.IntegralType)]
    for names, suite, value in ((text, TEXT_PROBES, lambda f: F.trim(F.col(f))), (whole, NUMBER_PROBES, lambda f: F.col(f).cast("bigint"))):
        if not names:
            continue
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("v")) for f in names])
        rows = df.select(F.explode(pairs).alias("p")).select("p.field", "p.v")
        there = F.col("v").isNotNull()
        told = rows.select("field", there.alias("_there"), *[F.coalesce(t(F.col("v")), F.lit(False)).alias(k) for k, t in suite.items()])
        sets = told.groupBy("field", "_there", *suite).agg(F.count(F.lit(1)).alias("_n"))
        of = F.sum(F.when(F.col("_there"), F.col("_n")))
        rates = sets.groupBy("field").agg(*[(F.sum(F.when(F.col(k), F.col("_n")).otherwise(0)) / of).alias(k) for k in suite])
        found = F.array(*[F.struct(F.lit(k).alias("probe"), F.lit(i).alias("position"), F.col(k).alias("rate")) for i, k in enumerate(suite)])
        out = out.unionByName(rates.select("field", F.explode(found).alias("r")).select("field", "r.probe", "r.position", "r.rate"))
    return out


def semantic_types(rates: DataFrame, threshold: float = RATE) -> DataFrame:
    """(field, probe, rate) of each field's winner: the best rate at or over the threshold, of equals the later probe."""
    w = Window.partitionBy("field").orderBy(F.desc("rate"), F.desc("position"))
    best = rates.where(F.col("rate") >= threshold).withColumn("r", F.row_number().over(w))
    return best.where("r = 1").select("field", "probe", "rate")


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): every field's values as text, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, records, present, nulls, encoding)."""
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f, encoding(df.schema[f].dataType))])
    n = df.agg(F.count(F.lit(1)).alias("records"), *[F.count(f).alias(f"_{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("present")) for i, f in enumerate(fields)])
    return n.select("records", F.explode(rows).alias("r")).select("r.field", "records", "r.present", (F.col("records") - F.col("r.present")).alias("nulls"), kinds[F.col("r.field")].alias("encoding"))


def cardinality(df: DataFrame, fields: list[str], exact: bool = True) -> DataFrame:
    """(field, distinct, regime): Constant, Binary, LowCard, MidCard or HighCardOrUnique; counted exactly or by HyperLogLog."""
    if exact:
        n = _long(df, fields).where("value IS NOT NULL").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("distinct"))
    else:
        wide = df.agg(*[F.approx_count_distinct(f, 0.016).alias(f) for f in fields])
        n = wide.unpivot([], fields, "field", "distinct")
    c = F.col("distinct")
    regime = F.when(c <= 1, "Constant").when(c == 2, "Binary").when(c <= LOW, "LowCard").when(c <= MID, "MidCard").otherwise("HighCardOrUnique")
    return n.withColumn("regime", regime)


def hll(df: DataFrame, field: str, lg: int = 12) -> DataFrame:
    """(estimate, stderr) by a mergeable sketch of 2^lg registers."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(field, lg)).alias("estimate")).withColumn("stderr", F.lit(1.04 / 2 ** (lg / 2)))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n records by the smallest seeded hashes of their key: the same rows in any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def moments(df: DataFrame, field: str) -> DataFrame:
    """count, mean, min, max, sample variance, skewness, excess kurtosis (0 where all values are equal); NaN skipped."""
    x = df.where(F.col(field).isNotNull() & ~F.isnan(F.col(field).cast("double"))).select(F.col(field).cast("double").alias("x"))
    flat = F.var_pop("x") == 0
    return x.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.when(flat, 0.0).otherwise(F.skewness("x")).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis("x")).alias("excess_kurtosis"))


QUANTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def quantiles(df: DataFrame, field: str) -> DataFrame:
    """(p, value) by linear interpolation; exact, and by ranges of values, so that no task holds them all."""
    at = percentiles(df.select(F.col(field).cast("double").alias("x")), list(QUANTILES))
    return at.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{i}").alias("value")) for i, p in enumerate(QUANTILES)])).alias("r")).select("r.*")


def quantile_sketch(df: DataFrame, field: str, k: int = 1000) -> DataFrame:
    """(p, value) from a mergeable KLL sketch, for inputs whose exact quantiles cost too much."""
    at = df.agg(F.kll_sketch_agg_double(F.col(field).cast("double"), F.lit(k)).alias("s"))
    return at.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("s", F.lit(p / 100)).alias("value")) for p in QUANTILES])).alias("r")).select("r.*")


def monotonicity(df: DataFrame, field: str, ordinal: str, bound: int = 512, part: int = 100_000) -> DataFrame:
    """Steps up, down and level between neighbours in order, and Mann-Kendall tau over the first ``bound`` values.

    Steps within a range of ordinals are counted there; the step between two ranges is taken from
    their ends, so that no task holds all records.
    """
    x = df.where(F.col(field).isNotNull() & ~F.isnan(F.col(field).cast("double"))).select(F.col(ordinal).cast("long").alias("o"), F.col(field).cast("double").alias("x"))
    x = x.withColumn("part", F.floor(F.col("o") / part))
    inner = x.withColumn("before", F.lag("x").over(Window.partitionBy("part").orderBy("o")))
    up, down, level = F.count_if(F.col("x") > F.col("before")).alias("up"), F.count_if(F.col("x") < F.col("before")).alias("down"), F.count_if(F.col("x") == F.col("before")).alias("level")
    ends = x.groupBy("part").agg(F.min_by("x", "o").alias("first"), F.max_by("x", "o").alias("last"))
    edge = ends.select(F.col("first").alias("x"), F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row per range
    steps = inner.agg(up, down, level).unionByName(edge.agg(up, down, level)).agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("level").alias("level"))
    # The first values are few: they are compared inside one row.
    first = x.orderBy("o").limit(bound).agg(F.sort_array(F.collect_list(F.struct("o", "x"))).alias("s")).select(F.col("s.x").alias("v"))
    signs = F.aggregate(F.transform("v", lambda a, i: F.aggregate(F.slice("v", i + 2, bound), F.lit(0), lambda acc, b: acc + F.signum(b - a).cast("int"))), F.lit(0), lambda acc, s: acc + s)
    n = F.size("v")
    tau = first.select(F.when(n >= 2, signs / (n * (n - 1) / 2)).alias("tau"))
    t = F.col("tau")
    name = F.when(t.isNull(), "Unknown").when(t > 0.7, "StrictlyAscending").when(t > 0.3, "MostlyAscending").when(t < -0.7, "StrictlyDescending").when(t < -0.3, "MostlyDescending").otherwise("Random")
    return steps.crossJoin(F.broadcast(tau)).withColumn("class", name)


def bit_width(df: DataFrame, field: str) -> DataFrame:
    """(count, min, max, range, bits_used, density, avg_popcount, class) of integers."""
    c = F.col(field).cast("long")
    at = df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(F.bit_count(c)).alias("avg_popcount"))
    span = F.col("max").cast("decimal(20,0)") - F.col("min").cast("decimal(20,0)")
    at = at.withColumn("range", span.cast("decimal(20,0)"))
    bits = F.when(F.col("range") == 0, 0).otherwise(F.length(F.bin(F.col("range").cast("long")))).cast("int")
    at = at.withColumns({"bits_used": bits, "density": F.col("count") / F.greatest(F.col("range").cast("double"), F.lit(1.0))})
    name = F.when(F.col("range") == 0, "Constant").when((F.col("bits_used") <= 8) & (F.col("density") > 0.5), "PackedEnum").when(F.col("density") > 0.1, "Sequential").when(F.col("avg_popcount") > 28, "HashLike").otherwise("Sparse")
    return at.withColumns({"class": name, "range": F.col("range").cast("double")})


def discrete_share(df: DataFrame, field: str) -> DataFrame:
    """The share of whole numbers among a float field's values."""
    return df.where(F.col(field).isNotNull()).agg(F.avg((F.col(field) == F.floor(field)).cast("double")).alias("integer_share"))


def frequency(df: DataFrame, field: str) -> DataFrame:
    """(value, n, p)."""
    n = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("t")).alias("p"))


def frequency_summary(df: DataFrame, field: str) -> DataFrame:
    """(distinct, mode, mode_count, entropy_bits, gini_simpson)."""
    f = frequency(df, field)
    best = F.min(F.struct(-F.col("n"), "value"))
    return f.agg(F.count(F.lit(1)).alias("distinct"), best["value"].alias("mode"), F.max("n").alias("mode_count"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini_simpson"))


def heavy_hitters(df: DataFrame, field: str, k: int = 64) -> DataFrame:
    """(value, n) of the k most frequent values; exact."""
    return frequency(df, field).select("value", "n").orderBy(F.desc("n"), "value").limit(k)


def heavy_hitter_sketch(df: DataFrame, field: str, k: int = 64, tracked: int = 10_000) -> DataFrame:
    """(value, n) from a bounded sketch."""
    at = df.where(F.col(field).isNotNull()).agg(F.expr(f"approx_top_k({field}, {k}, {tracked})").alias("t"))
    return at.select(F.inline("t")).toDF("value", "n")


def lengths(df: DataFrame, field: str) -> DataFrame:
    """(unit, count, min, max, mean, variance, p1 .. p99) of lengths in bytes and in characters."""
    both = F.array(F.struct(F.lit("bytes").alias("unit"), F.octet_length(field).alias("n")), F.struct(F.lit("chars").alias("unit"), F.char_length(field).alias("n")))
    rows = df.where(F.col(field).isNotNull()).select(F.explode(both).alias("r")).select("r.*")
    return rows.groupBy("unit").agg(F.count("n").alias("count"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.var_samp("n").alias("variance"), *[F.expr(f"percentile(n, {p / 100})").alias(f"p{p}") for p in QUANTILES])


#: Spark's classes of characters; ASCII punctuation stands last as other classes come first.
CLASSES = {"alpha": r"\p{IsAlphabetic}", "digit": "[0-9]", "whitespace": r"\p{IsWhite_Space}", "punct": r"[!-/:-@\[-`{-~]"}


def char_mix(df: DataFrame, field: str) -> DataFrame:
    """(count, alpha, digit, whitespace, punct, other): mean shares of characters per non-empty value."""
    c = F.col(field)
    n = F.char_length(c)
    parts = {k: F.regexp_count(c, F.lit(p)) / n for k, p in CLASSES.items()}
    rows = df.where(n > 0).select(*[v.alias(k) for k, v in parts.items()])
    rows = rows.withColumn("other", 1 - sum((F.col(k) for k in CLASSES), F.lit(0.0)))
    return rows.agg(F.count(F.lit(1)).alias("count"), *[F.avg(k).alias(k) for k in (*CLASSES, "other")])


def skeleton(c: Column) -> Column:
    """The shape of a text: letters A, digits 9, white space _, anything else ?, a run as its class and +; ``@ . - _ : / , +`` stand for themselves.

    Classes are written as private-use characters first, so that those signs cannot be taken for them.
    """
    marks = [(p, chr(0xE000 + i), name) for i, (p, name) in enumerate((("[A-Za-z]", "A"), ("[0-9]", "9"), (r"\s", "_"), (r"[^@.\-_:/,+\x{E000}-\x{E002}]", "?")))]
    for pattern, mark, _ in marks:
        c = F.regexp_replace(c, pattern, mark)
    for _, mark, name in marks:
        c = F.replace(F.regexp_replace(c, f"{mark}{{2,}}", f"{name}+"), F.lit(mark), F.lit(name))
    return c


def skeletons(df: DataFrame, field: str, k: int = 64) -> DataFrame:
    """(pattern, n): the most frequent shapes."""
    n = df.where(F.col(field).isNotNull()).groupBy(skeleton(F.col(field)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "pattern").limit(k)


def trigrams(df: DataFrame, field: str, k: int = 1024) -> DataFrame:
    """(trigram, n): the most frequent runs of three characters, overlapping."""
    found = F.regexp_extract_all(field, F.lit("(?s)(?=(...))"), F.lit(1))
    rows = df.select(F.explode(found).alias("trigram"))
    return rows.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "trigram").limit(k)


def labels(df: DataFrame, field: str, k: int = 64) -> DataFrame:
    """(label, n) over values of labelset shape."""
    rows = df.where(is_labelset(F.col(field))).select(F.explode(F.transform(F.split(field, ","), lambda x: F.trim(x))).alias("label")).where("label <> ''")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def temporal(df: DataFrame, field: str) -> DataFrame:
    """(count, first, last, span_seconds, granularity): seconds since 1970; the coarsest unit that every value is a multiple of."""
    us = F.unix_micros(F.col(field).cast("timestamp"))
    at = df.agg(F.count(field).alias("count"), F.min(us).alias("a"), F.max(us).alias("b"), *[F.bool_and(us % n == 0).alias(u) for u, n in (("day", 86_400_000_000), ("hour", 3_600_000_000), ("minute", 60_000_000), ("second", 1_000_000), ("milli", 1000))])
    unit = F.lit("micro")
    for u in ("milli", "second", "minute", "hour", "day"):
        unit = F.when(F.col(u), u).otherwise(unit)
    return at.select("count", F.floor(F.col("a") / 1_000_000).alias("first"), F.floor(F.col("b") / 1_000_000).alias("last"), ((F.col("b") - F.col("a")) / 1e6).alias("span_seconds"), unit.alias("granularity"))


def epoch(df: DataFrame, field: str) -> DataFrame:
    """(seconds_share, millis_share): integers that are plausible times of this century."""
    c = F.col(field)
    return df.where(c.isNotNull()).agg(*[F.avg(NUMBER_PROBES[f"epoch_{u}"](c).cast("double")).alias(f"{u}_share") for u in ("seconds", "millis")])


def byte_entropy(df: DataFrame, field: str) -> DataFrame:
    """(observations, total_bytes, entropy_bits, class) over all bytes of a binary or text field."""
    rows = df.where(F.col(field).isNotNull()).select(F.hex(F.col(field).cast("binary")).alias("h"))
    n = rows.agg(F.count(F.lit(1)).alias("observations"))
    pairs = F.regexp_extract_all("h", F.lit(".."), F.lit(0))
    per = rows.select(F.explode(pairs).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    t = per.agg(F.sum("k").alias("t"))
    e = per.crossJoin(F.broadcast(t)).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total_bytes"), F.coalesce(-F.sum(F.col("k") / F.col("t") * F.log2(F.col("k") / F.col("t"))), F.lit(0.0)).alias("entropy_bits"))
    h = F.col("entropy_bits")
    name = F.when(F.col("total_bytes") == 0, "Empty").when(h >= 7.5, "Compressed").when(h >= 5, "MixedHighEntropy").when(h >= 2, "Structured").otherwise("LowEntropy")
    return n.crossJoin(e).withColumn("class", name)


def type_tags(df: DataFrame, json_col: str, path: str) -> DataFrame:
    """(tag, n): the types that a JSON field has, for fields whose type is not stable."""
    v = F.variant_get(F.try_parse_json(json_col), path, "variant")
    return df.groupBy(F.coalesce(F.schema_of_variant(v), F.lit("ABSENT")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


# Pairs of fields.


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, r, slope, intercept) of b on a where both are there."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull())
    at = both.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("vx") > 0, F.col("c") / F.nullif("vx", F.lit(0.0)))
    r = F.when((F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0)))
    return at.select("n", r.alias("r"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, cramers_v, mutual_information): chi-square over the full grid.

    A cell that is empty adds its expected count, and all expected counts add up to n: so chi-square is
    the sum of n_ij^2 n / (n_i n_j) over the cells there are, less n. The grid is never built.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    rows, cols = cells.groupBy("a").agg(F.sum("k").alias("ra")), cells.groupBy("b").agg(F.sum("k").alias("cb"))
    n = cells.agg(F.sum("k").alias("n"))
    size = rows.agg(F.count(F.lit(1)).alias("nr")).crossJoin(cols.agg(F.count(F.lit(1)).alias("nc")))
    at = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(n))
    k, e = F.col("k").cast("double"), F.col("ra").cast("double") * F.col("cb") / F.col("n")
    out = at.agg(F.max("n").alias("n"), F.sum(k * k / e).alias("s"), F.sum(k / F.col("n") * F.log2(k / e)).alias("mutual_information")).crossJoin(size)
    chi = F.col("s") - F.col("n")
    least = F.least("nr", "nc") - 1
    return out.select("n", chi.alias("chi2"), F.when(least > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("n") * least))).alias("cramers_v"), "mutual_information")


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n, groups, eta_squared): the share of variance between groups; null for fewer than two values or groups, or no variance."""
    x = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    per = x.groupBy("g").agg(F.count("x").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_ = per.agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mean"))
    at = per.crossJoin(F.broadcast(all_)).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("k") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"), F.sum(F.col("k") * F.col("v")).alias("ssw"))
    total = F.col("ssb") + F.col("ssw")
    return at.select("n", "groups", F.when((F.col("n") >= 2) & (F.col("groups") >= 2) & (total > 0), F.col("ssb") / total).alias("eta_squared"))


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, support, determinants, deterministic): how far a decides b: the share of rows with the most frequent b of their a."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("k"))
    per = cells.groupBy(a).agg(F.max("k").alias("best"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("values"))
    return per.agg(F.sum("k").alias("n"), (F.sum("best") / F.sum("k")).alias("support"), F.count(F.lit(1)).alias("determinants"), F.count_if(F.col("values") == 1).alias("deterministic"))


def copresence(df: DataFrame, a: str, b: str) -> DataFrame:
    """(both, a_only, b_only, neither, jaccard, a_given_b, b_given_a)."""
    x, y = F.col(a).isNotNull(), F.col(b).isNotNull()
    at = df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))

    def share(whole: Column) -> Column:
        return F.when(whole > 0, F.col("both") / whole)

    both, ao, bo = F.col("both"), F.col("a_only"), F.col("b_only")
    return at.withColumns({"jaccard": share(both + ao + bo), "a_given_b": share(both + bo), "b_given_a": share(both + ao)})


def trend(df: DataFrame, field: str, ordinal: str) -> DataFrame:
    """(n, r, slope) of a field over the record's ordinal."""
    return pearson(df, ordinal, field).select("n", "r", "slope")


#: Which measures a field gets, by what pass one found.
MEASURES = {"Numeric": ["moments", "quantiles", "histogram", "monotonicity"], "Textual": ["lengths", "char_mix", "skeletons", "trigrams"], "Bytes": ["byte_entropy"], "Bool": ["frequency"]}


def plan(df: DataFrame, fields: list[str]) -> dict[str, list[str]]:
    """Measures per field: by its encoding, and the frequency table or the heavy hitters by its cardinality regime."""
    regimes = {r["field"]: r["regime"] for r in cardinality(df, fields, exact=False).collect()}
    out = {}
    for f in fields:
        own = list(MEASURES.get(encoding(df.schema[f].dataType), []))
        if regimes[f] in ("Constant", "Binary", "LowCard"):
            own.append("frequency")
        elif regimes[f] in ("MidCard", "HighCardOrUnique"):
            own += ["heavy_hitters", "hll"]
        if isinstance(df.schema[f].dataType, T.IntegralType):
            own += ["bit_width", "epoch"]
        if isinstance(df.schema[f].dataType, T.TimestampType):
            own = ["temporal"]
        out[f] = list(dict.fromkeys(own))
    return out


def findings(df: DataFrame, fields: list[str]) -> str:
    """A short report as JSON: presence, type and regime of each field, and the measures it would get."""
    here = {r["field"]: r.asDict() for r in presence(df, fields).collect()}
    kinds = {r["field"]: r["probe"] for r in semantic_types(probe_rates(df, fields)).collect()}
    regimes = {r["field"]: r["regime"] for r in cardinality(df, fields, exact=False).collect()}
    todo = plan(df, fields)
    rows = [here[f] | {"semantic": kinds.get(f), "regime": regimes.get(f), "measures": todo[f], "severity": "warn" if here[f]["nulls"] else "info"} for f in fields]
    return json.dumps({"fields": rows}, indent=2)
