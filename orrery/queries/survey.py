"""The metadata survey over documents, events, orders, customers, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import stats, survey, survey_run
from orrery.queries.vectors import rounded
from orrery.session import spread, table

FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with every seventh customer and every fifth priority missing."""
    o = table(spark, sf, "orders")
    blank = {"o_custkey": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")), "o_orderpriority": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))}
    return o.withColumns(blank)


def probed(spark: SparkSession, sf: str) -> DataFrame:
    """A column of each text shape, made from the keys of orders."""
    k = F.col("o_orderkey")
    t = k.cast("string")
    hexed = F.lpad(F.lower(F.hex(k)), 12, "0")
    cols = {
        "i": t, "dec": F.concat(t, F.lit(".25")), "flt": F.concat(t, F.lit("e3")), "bool": F.when(k % 2 == 0, "yes").otherwise("No"),
        "uuid": F.concat(F.lit("01234567-89ab-cdef-0123-"), hexed), "day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "time": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "mail": F.concat(F.lit("user"), t, F.lit("@example.org")), "url": F.concat(F.lit("https://example.org/"), t),
        "v4": F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".1")), "v6": F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 65536))), "phone": F.concat(F.lit("+1 555 "), F.lpad(t, 7, "0")),
        "geo": F.concat((k % 90).cast("string"), F.lit(", "), (k % 180).cast("string"), F.lit(".5")), "money": F.concat(F.lit("$1,"), F.lpad((k % 1000).cast("string"), 3, "0")),
        "hash": F.concat(F.lit("0x"), hexed), "json": F.concat(F.lit('{"k": '), t, F.lit("}")), "comp": F.concat(F.lit("ORD-"), t), "tags": F.concat(F.lit("red, "), "o_orderstatus", F.lit(",new")),
    }
    return spread(table(spark, sf, "orders")).select(*[c.alias(n) for n, c in cols.items()])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat_ws(", ", "lang", "source", F.when(F.col("doc_id") % 3 == 0, "extra label")).alias("tags"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    p = probed(spark, sf)
    return rounded(survey.probe_rates(p, p.columns).select("field", "probe", "rate"))


def _types(spark: SparkSession, sf: str) -> DataFrame:
    p = probed(spark, sf)
    return rounded(survey.semantic_types(survey.probe_rates(p, p.columns)))


def _hll(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch's estimate against the exact count, within three standard errors."""
    o = table(spark, sf, "orders")
    exact = o.agg(F.count_distinct("o_custkey").alias("exact"))
    return survey.hll(o, "o_custkey").crossJoin(exact).select("exact", (F.abs(F.col("estimate") / F.col("exact") - 1) < 3 * F.col("stderr")).alias("within"))


def _quantile_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The share of values at or below each estimate lies within a hundredth of its rank."""
    o = table(spark, sf, "orders")
    q = survey.quantile_sketch(o, "o_totalprice")
    rank = o.crossJoin(F.broadcast(q)).groupBy("p").agg(F.avg((F.col("o_totalprice") <= F.col("value")).cast("double")).alias("rank"))
    return rank.select("p", (F.abs(F.col("rank") - F.col("p") / 100) < 0.01).alias("within"))


def _top_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return survey.heavy_hitter_sketch(table(spark, sf, "orders"), "o_orderpriority", 5)


#: Fields of a whole survey, the measures that SQL repeats, and pairs of fields.
WHOLE = [*FIELDS, "o_orderdate"]
ONLY = {"Presence", "TypeStability", "ExactExtrema", "ExactFrequencyTable", "Copresence", "NumericCorrelation", "CategoricalAssociation", "FunctionalDependency"}
PAIRS = [(a, b) for i, a in enumerate(WHOLE) for b in WHOLE[i + 1 :]]


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return survey_run.plan(orders(spark, sf), "o_orderkey", WHOLE)


def _run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survey_run.run(orders(spark, sf), "o_orderkey", WHOLE, only=ONLY), "value", digits=5)


QUERIES = {
    "survey_plan": _plan,
    "survey_run": _run,
    "survey_presence": lambda s, sf: survey.presence(orders(s, sf), FIELDS),
    "semantic_probes": _probes,
    "semantic_types": _types,
    "cardinality_regime": lambda s, sf: survey.cardinality(orders(s, sf), FIELDS),
    "survey_sample": lambda s, sf: survey.sample(table(s, sf, "orders"), 100, "o_orderkey", 7).select("o_orderkey"),
    "survey_moments": lambda s, sf: rounded(survey.moments(table(s, sf, "lineitem"), "l_extendedprice"), "mean", "skewness", "excess_kurtosis", digits=5).withColumn("variance", F.round("variance", 1)),
    "survey_quantiles": lambda s, sf: rounded(survey.quantiles(table(s, sf, "orders"), "o_totalprice"), "value"),
    "survey_quantile_sketch": _quantile_sketch,
    "survey_histogram": lambda s, sf: rounded(stats.histogram(table(s, sf, "orders").select(F.col("o_totalprice").alias("x")), 32)),
    "survey_monotonicity": lambda s, sf: rounded(survey.monotonicity(table(s, sf, "orders"), "o_totalprice", "o_orderkey", 200, 1000)),
    "survey_bit_width": lambda s, sf: rounded(survey.bit_width(table(s, sf, "orders"), "o_custkey")),
    "survey_discrete": lambda s, sf: rounded(survey.discrete_share(table(s, sf, "lineitem"), "l_extendedprice")),
    "survey_hll": _hll,
    "survey_heavy_hitters": lambda s, sf: survey.heavy_hitters(orders(s, sf), "o_custkey"),
    "survey_top_sketch": _top_sketch,
    "survey_frequency": lambda s, sf: rounded(survey.frequency(orders(s, sf), "o_orderpriority")),
    "survey_frequency_summary": lambda s, sf: rounded(survey.frequency_summary(orders(s, sf), "o_orderpriority")),
    "survey_lengths": lambda s, sf: rounded(survey.lengths(docs(s, sf), "text"), digits=4),
    "survey_char_mix": lambda s, sf: rounded(survey.char_mix(docs(s, sf), "text")),
    "survey_skeleton": lambda s, sf: survey.skeletons(table(s, sf, "pages"), "url"),
    "survey_trigrams": lambda s, sf: survey.trigrams(docs(s, sf), "text"),
    "survey_labels": lambda s, sf: survey.labels(labelled(s, sf), "tags"),
    "survey_temporal": lambda s, sf: rounded(survey.temporal(table(s, sf, "events"), "ts")),
    "survey_epoch": lambda s, sf: rounded(survey.epoch(table(s, sf, "orders").select((F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * F.when(F.col("o_orderkey") % 4 == 0, 1000).otherwise(1)).alias("t")), "t")),
    "survey_byte_entropy": lambda s, sf: rounded(survey.byte_entropy(docs(s, sf).withColumn("b", F.encode("text", "utf-8")), "b")),
    "survey_type_tags": lambda s, sf: survey.type_tags(table(s, sf, "events"), "props", "$.k"),
    "cross_pearson": lambda s, sf: rounded(survey.pearson(table(s, sf, "lineitem"), "l_quantity", "l_extendedprice"), "r", "slope", "intercept", digits=5),
    "cross_cramers_v": lambda s, sf: rounded(survey.cramers_v(table(s, sf, "lineitem"), "l_returnflag", "l_linestatus"), "chi2", "cramers_v", "mutual_information", digits=5),
    "cross_eta_squared": lambda s, sf: rounded(survey.eta_squared(table(s, sf, "customer"), "c_mktsegment", "c_acctbal")),
    "cross_functional_dep": lambda s, sf: rounded(survey.functional_dependency(table(s, sf, "nation"), "n_nationkey", "n_regionkey").unionByName(survey.functional_dependency(table(s, sf, "part"), "p_brand", "p_type"))),
    "cross_copresence": lambda s, sf: rounded(survey.copresence(orders(s, sf), "o_custkey", "o_orderpriority")),
    "cross_trend": lambda s, sf: rounded(survey.trend(table(s, sf, "orders"), "o_totalprice", "o_orderkey"), "r", "slope"),
}

_O = "o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"
_KINDS = {"o_orderkey": "Numeric", "o_custkey": "Numeric", "o_orderstatus": "Textual", "o_totalprice": "Numeric", "o_orderpriority": "Textual"}
_NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_P = r"""p AS (SELECT o_orderkey::VARCHAR AS i, o_orderkey || '.25' AS dec, o_orderkey || 'e3' AS flt, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END AS bool,
'01234567-89ab-cdef-0123-' || lpad(lower(to_hex(o_orderkey)), 12, '0') AS uuid, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS time,
'user' || o_orderkey || '@example.org' AS mail, 'https://example.org/' || o_orderkey AS url, '10.0.' || (o_orderkey % 256) || '.1' AS v4, '2001:db8::' || lower(to_hex(o_orderkey % 65536)) AS v6,
'+1 555 ' || CASE WHEN length(o_orderkey::VARCHAR) > 7 THEN left(o_orderkey::VARCHAR, 7) ELSE lpad(o_orderkey::VARCHAR, 7, '0') END AS phone, (o_orderkey % 90) || ', ' || (o_orderkey % 180) || '.5' AS geo, '$1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS money,
'0x' || lpad(lower(to_hex(o_orderkey)), 12, '0') AS hash, '{"k": ' || o_orderkey || '}' AS json, 'ORD-' || o_orderkey AS comp, 'red, ' || o_orderstatus || ',new' AS tags FROM orders),
l AS (UNPIVOT p ON COLUMNS(*) INTO NAME field VALUE v)"""
_TESTS = {
    "integer": "regexp_full_match(v, '[+-]?[0-9]+')",
    "decimal": f"contains(v, '.') AND NOT regexp_matches(v, '[eE]') AND regexp_matches(v, '{_NUM}')",
    "float": f"regexp_matches(v, '[eE]') AND regexp_matches(v, '{_NUM}')",
    "boolean": "lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '1', '0')",
    "uuid": "regexp_full_match(v, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')",
    "iso_date": "regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
    "iso_datetime": "strlen(v) >= 19 AND regexp_matches(v, '^.{4}-.{2}-.{2}[T ].{2}:.{2}:.{2}')",
    "email": "regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*[.][A-Za-z0-9.-]*[A-Za-z0-9-]')",
    "url": "strlen(v) >= 8 AND regexp_matches(lower(v), '^(http|https|s3|file)://.')",
    "ipv4": "regexp_full_match(v, '([0-9]+[.]){3}[0-9]+')",
    "ipv6": "regexp_full_match(v, '2001:db8::[0-9a-f]{1,4}')",
    "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND regexp_matches(v, '[+(-]') AND NOT regexp_matches(v, '[A-Za-z]')",
    "geocode": f"contains(v, ',') AND regexp_matches(trim(split_part(v, ',', 1)), '{_NUM}') AND regexp_matches(trim(substr(v, instr(v, ',') + 1)), '{_NUM}')",
    "currency": "regexp_full_match(v, '[$][0-9,]+')",
    "hex": "regexp_full_match(v, '(0[xX])?[0-9a-fA-F]{8,}')",
    "json": "regexp_matches(v, '^[{]') AND json_valid(v)",
    "composite_id": "regexp_full_match(v, '[A-Za-z]{2,}[_-][A-Za-z0-9]+') AND length(regexp_replace(split_part(v, '-', 2), '[^0-9]', '', 'g')) * 2 >= length(split_part(v, '-', 2))",
    "labelset": r"regexp_full_match(v, '\s*[^\s,]+(\s+[^\s,]+){0,2}\s*(,\s*[^\s,]+(\s+[^\s,]+){0,2}\s*)+')",
}
_RATES = " UNION ALL ".join(f"SELECT field, '{k}' AS probe, {i} AS position, avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) AS rate FROM l GROUP BY field" for i, (k, t) in enumerate(_TESTS.items()))
_X = "SELECT o_totalprice AS x FROM orders"


def _sk(c: str) -> str:
    for p, i in (("[A-Za-z]", 0), ("[0-9]", 1), (r"\s", 2), (r"[^@.\-_:/,+\x{E000}-\x{E002}]", 3)):
        c = f"regexp_replace({c}, '{p}', chr({0xE000 + i}), 'g')"
    for i, n in enumerate("A9_?"):
        c = f"replace(regexp_replace({c}, chr({0xE000 + i}) || '{{2,}}', '{n}+', 'g'), chr({0xE000 + i}), '{n}')"
    return c


_LOW, _NUM_FIELDS = ("o_orderstatus", "o_orderpriority"), ("o_orderkey", "o_custkey", "o_totalprice")


def _row(subject: str, other: str | None, measure: str, item: str, value: str, source: str) -> str:
    named = "NULL::VARCHAR" if other is None else f"'{other}'"
    return f"SELECT '{subject}' AS subject, {named} AS other, '{measure}' AS measure, {item} AS item, round(({value})::DOUBLE, 5) AS value, NULL::VARCHAR AS text FROM {source}"


def _whole_run() -> str:
    out = [_row(f, None, "Presence", f"'{i}'", v, "o") for f in WHOLE for i, v in (("records", "count(*)"), ("present", f"count({f})"), ("nulls", f"count(*) - count({f})"))]
    out += [_row(f, None, "TypeStability", f"'{i}'", "1", "(SELECT 1)") for f in WHOLE for i in ("types", "stable")]
    out += [_row(f, None, "ExactExtrema", f"'{i}'", f"{i}({f})", "o") for f in _NUM_FIELDS for i in ("min", "max")]
    for f in _LOW:
        n = f"(SELECT {f} AS v, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM o WHERE {f} IS NOT NULL GROUP BY 1)"
        out += [_row(f, None, "ExactFrequencyTable", f"v || '.{i}'", i, n) for i in ("n", "p")]
    for a, b in PAIRS:
        c = f"(SELECT count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS both_, count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS a_only, count(*) FILTER ({a} IS NULL AND {b} IS NOT NULL) AS b_only, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS neither FROM o)"
        items = {"both": "both_", "a_only": "a_only", "b_only": "b_only", "neither": "neither", "jaccard": "both_ / (both_ + a_only + b_only)", "a_given_b": "both_ / (both_ + b_only)", "b_given_a": "both_ / (both_ + a_only)"}
        out += [_row(a, b, "Copresence", f"'{i}'", v, c) for i, v in items.items()]
        if a in _NUM_FIELDS and b in _NUM_FIELDS:
            both = f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM o WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            out += [_row(a, b, "NumericCorrelation", f"'{i}'", v, both) for i, v in (("n", "count(*)"), ("r", "corr(x, y)"), ("slope", "regr_slope(y, x)"), ("intercept", "regr_intercept(y, x)"))]
    for a in _LOW:
        for b in WHOLE:
            if a != b:
                g = f"(SELECT sum(k) AS k, max(k) AS best, count(*) AS v FROM (SELECT {a}, {b}, count(*) AS k FROM o WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) GROUP BY {a})"
                out += [_row(a, b, "FunctionalDependency", f"'{i}'", v, g) for i, v in (("n", "sum(k)"), ("support", "sum(best) / sum(k)"), ("determinants", "count(*)"), ("deterministic", "count(*) FILTER (v = 1)"))]
    a, b = _LOW
    cells = f"""(WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS k FROM o WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
r AS (SELECT a, sum(k) AS ra FROM c GROUP BY a), s AS (SELECT b, sum(k) AS cb FROM c GROUP BY b), n AS (SELECT sum(k) AS n FROM c)
SELECT coalesce(k, 0) AS k, ra * cb / n AS e, n, least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) - 1 AS d FROM r CROSS JOIN s CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = s.b)"""
    items = {"n": "max(n)", "chi2": "sum((k - e) ** 2 / e)", "cramers_v": "sqrt(sum((k - e) ** 2 / e) / (max(n) * max(d)))", "mutual_information": "sum(CASE WHEN k > 0 THEN k / n * log2(k / e) ELSE 0 END)"}
    out += [_row(a, b, "CategoricalAssociation", f"'{i}'", v, cells) for i, v in items.items()]
    return f"WITH {_O} " + "\nUNION ALL ".join(out)


def _whole_plan() -> str:
    """Measures by type, which is fixed, and by regime, which is counted."""
    kinds = {f: ("Number" if f in _NUM_FIELDS else "Temporal" if f == "o_orderdate" else "FreeText") for f in WHOLE}
    fixed = []
    for f, k in kinds.items():
        own = [*survey_run.ALWAYS]
        if k == "Number":
            own += [*survey_run.NUMERIC, *(["DiscreteIndicator"] if f == "o_totalprice" else ["BitWidth", "EpochPlausibility"])]
        own += ["TemporalRange"] if k == "Temporal" else [*survey_run.SHAPE, "TrigramHeavyHitters"] if k == "FreeText" else []
        fixed += [f"('{f}', '{m}', '{k}')" for m in own]
    counts = " UNION ALL ".join(f"SELECT '{f}' AS f, count(DISTINCT {f}) AS d FROM o" for f in WHOLE)
    low, number = "regime IN ('Constant', 'Binary', 'LowCard')", "f IN ('o_orderkey', 'o_custkey', 'o_totalprice')"
    order = "CASE f " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(WHOLE)) + " END"
    return f"""WITH {_O}, r AS (SELECT f, {order} AS i, CASE WHEN d <= 1 THEN 'Constant' WHEN d = 2 THEN 'Binary' WHEN d <= 64 THEN 'LowCard' WHEN d <= 4096 THEN 'MidCard' ELSE 'HighCardOrUnique' END AS regime FROM ({counts})),
k AS (SELECT f, i, regime, {low} AS low, {number} AS num FROM r),
m AS (SELECT f, m, family, regime FROM (VALUES {', '.join(fixed)}) AS v(f, m, family) JOIN r USING (f)),
fam AS (SELECT DISTINCT f, family FROM m),
g AS (SELECT f, unnest(CASE WHEN {low} THEN ['ExactFrequencyTable'] WHEN regime = 'MidCard' THEN ['HyperLogLog', 'HeavyHitters'] ELSE ['HyperLogLog'] END) AS m, family, regime FROM r JOIN fam USING (f)),
p AS (SELECT a.f AS a, b.f AS b, a.low AS la, b.low AS lb, a.num AS na, b.num AS nb FROM k a JOIN k b ON a.i < b.i),
q AS (SELECT a, b, 'Copresence' AS m FROM p UNION ALL SELECT a, b, 'NumericCorrelation' FROM p WHERE na AND nb UNION ALL SELECT a, b, 'CategoricalAssociation' FROM p WHERE la AND lb
UNION ALL SELECT a, b, 'LowCardNumeric' FROM p WHERE la AND nb UNION ALL SELECT b, a, 'LowCardNumeric' FROM p WHERE na AND lb AND NOT (la AND nb)
UNION ALL SELECT a, b, 'FunctionalDependency' FROM p WHERE la UNION ALL SELECT b, a, 'FunctionalDependency' FROM p WHERE lb UNION ALL SELECT f, '{survey_run.INDEX}', 'Trend' FROM k WHERE num)
SELECT f AS subject, NULL::VARCHAR AS other, m AS measure, NULL::VARCHAR AS semantic, family, regime FROM (FROM m UNION ALL FROM g)
UNION ALL SELECT a, b, m, NULL, NULL, NULL FROM q"""


ORACLES = {
    "survey_plan": _whole_plan(),
    "survey_run": _whole_run(),
    "survey_presence": f"WITH {_O} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS records, count({f}) AS present, count(*) - count({f}) AS nulls, '{k}' AS encoding FROM o" for f, k in _KINDS.items()),
    "semantic_probes": f"WITH {_P}, r AS ({_RATES}) SELECT field, probe, round(rate, 6)::DOUBLE AS rate FROM r",
    "semantic_types": f"WITH {_P}, r AS ({_RATES}) SELECT field, probe, round(rate, 6)::DOUBLE AS rate FROM r WHERE rate >= 0.95 QUALIFY row_number() OVER (PARTITION BY field ORDER BY rate DESC, position DESC) = 1",
    "cardinality_regime": f"WITH {_O}, d AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) AS d FROM o" for f in _KINDS) + ") SELECT field, d AS distinct, CASE WHEN d <= 1 THEN 'Constant' WHEN d = 2 THEN 'Binary' WHEN d <= 64 THEN 'LowCard' WHEN d <= 4096 THEN 'MidCard' ELSE 'HighCardOrUnique' END AS regime FROM d".replace("AS distinct", 'AS "distinct"'),
    "survey_moments": """SELECT count(*) AS count, round(avg(x), 5) AS mean, min(x) AS min, max(x) AS max, round(var_samp(x), 1) AS variance, round(avg((x - m) ** 3) / (var_pop(x) ** 1.5), 5) AS skewness, round(avg((x - m) ** 4) / (var_pop(x) ** 2) - 3, 5) AS excess_kurtosis
FROM (SELECT l_extendedprice AS x, avg(l_extendedprice) OVER () AS m FROM lineitem)""",
    "survey_quantiles": f"WITH x AS ({_X}) " + " UNION ALL ".join(f"SELECT {p} AS p, round(quantile_cont(x, {p / 100}), 6) AS value FROM x" for p in survey.QUANTILES),
    "survey_quantile_sketch": f"SELECT unnest({list(survey.QUANTILES)})::INT AS p, true AS within",
    "survey_histogram": f"WITH x AS ({_X}), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 32 AS w FROM x), h AS (SELECT least(floor((x - lo) / w), 31)::INT AS bin, lo, w FROM x, e) SELECT bin, round(lo + bin * w, 6) AS low, count(*) AS n FROM h GROUP BY bin, lo, w",
    "survey_monotonicity": """WITH s AS (SELECT o_orderkey AS o, o_totalprice AS x, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders), f AS (SELECT o, x FROM s ORDER BY o LIMIT 200),
t AS (SELECT sum(sign(b.x - a.x)) / (count(*)) AS tau FROM f a JOIN f b ON a.o < b.o)
SELECT count(*) FILTER (x > b) AS up, count(*) FILTER (x < b) AS down, count(*) FILTER (x = b) AS level, round(max(tau), 6) AS tau, CASE WHEN max(tau) > 0.7 THEN 'StrictlyAscending' WHEN max(tau) > 0.3 THEN 'MostlyAscending' WHEN max(tau) < -0.7 THEN 'StrictlyDescending' WHEN max(tau) < -0.3 THEN 'MostlyDescending' ELSE 'Random' END AS class FROM s, t""",
    "survey_bit_width": """WITH a AS (SELECT count(*) AS count, min(o_custkey) AS min, max(o_custkey) AS max, avg(bit_count(o_custkey)) AS pop FROM orders)
SELECT count, min, max, (max - min)::DOUBLE AS range, length(bin(max - min))::INT AS bits_used, round(count / greatest(max - min, 1), 6) AS density, round(pop, 6) AS avg_popcount, CASE WHEN max = min THEN 'Constant' WHEN max - min < 256 AND count / (max - min) > 0.5 THEN 'PackedEnum' WHEN count / (max - min) > 0.1 THEN 'Sequential' WHEN pop > 28 THEN 'HashLike' ELSE 'Sparse' END AS class FROM a""",
    "survey_discrete": "SELECT round(avg(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS integer_share FROM lineitem",
    "survey_hll": "SELECT count(DISTINCT o_custkey) AS exact, true AS within FROM orders",
    "survey_heavy_hitters": f"WITH {_O} SELECT o_custkey::VARCHAR AS value, count(*) AS n FROM o WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 64",
    "survey_top_sketch": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    "survey_frequency": f"WITH {_O} SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    "survey_frequency_summary": f"""WITH {_O}, f AS (SELECT o_orderpriority AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT count(*) AS "distinct", arg_min(value, (-n, value)) AS mode, max(n) AS mode_count, round(-sum(p * log2(p)), 6) AS entropy_bits, round(1 - sum(p * p), 6) AS gini_simpson FROM f""",
    "survey_lengths": "WITH l AS (SELECT 'bytes' AS unit, strlen(text) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chars', length(text) FROM documents WHERE text IS NOT NULL) SELECT unit, count(*) AS count, min(n)::INT AS min, max(n)::INT AS max, round(avg(n), 4) AS mean, round(var_samp(n), 4) AS variance, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 4)::DOUBLE AS p{p}" for p in survey.QUANTILES) + " FROM l GROUP BY unit",
    "survey_char_mix": r"""WITH c AS (SELECT length(text) AS n, length(regexp_replace(text, '\P{L}', '', 'g')) AS a, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, length(regexp_replace(text, '[^\s]', '', 'g')) AS w, length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) AS p FROM documents WHERE length(text) > 0)
SELECT count(*) AS count, round(avg(a / n), 6) AS alpha, round(avg(d / n), 6) AS digit, round(avg(w / n), 6) AS whitespace, round(avg(p / n), 6) AS punct, round(avg(1 - (a / n + d / n + w / n + p / n)), 6) + 0.0 AS other FROM c""",
    "survey_skeleton": f"SELECT {_sk('url')} AS pattern, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, pattern LIMIT 64",
    "survey_trigrams": "SELECT trigram, count(*) AS n FROM (SELECT c[i] || c[i + 1] || c[i + 2] AS trigram FROM (SELECT c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT string_split(text, '') AS c FROM documents WHERE length(text) >= 3))) GROUP BY 1 ORDER BY n DESC, trigram LIMIT 1024",
    "survey_labels": "WITH t AS (SELECT concat_ws(', ', lang, source, CASE WHEN doc_id % 3 = 0 THEN 'extra label' END) AS tags FROM documents) SELECT trim(label) AS label, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS label FROM t) GROUP BY 1 ORDER BY n DESC, label LIMIT 64",
    "survey_temporal": """SELECT count(ts) AS count, floor(epoch_us(min(ts)) / 1e6)::BIGINT AS first, floor(epoch_us(max(ts)) / 1e6)::BIGINT AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_seconds,
CASE WHEN bool_and(epoch_us(ts) % 86400000000 = 0) THEN 'day' WHEN bool_and(epoch_us(ts) % 3600000000 = 0) THEN 'hour' WHEN bool_and(epoch_us(ts) % 60000000 = 0) THEN 'minute' WHEN bool_and(epoch_us(ts) % 1000000 = 0) THEN 'second' WHEN bool_and(epoch_us(ts) % 1000 = 0) THEN 'milli' ELSE 'micro' END AS granularity FROM events""",
    "survey_epoch": "WITH t AS (SELECT epoch(o_orderdate)::BIGINT * CASE WHEN o_orderkey % 4 = 0 THEN 1000 ELSE 1 END AS t FROM orders) SELECT round(avg((t >= 946684800 AND t < 4102444800)::INT), 6) AS seconds_share, round(avg((t >= 946684800000 AND t < 4102444800000)::INT), 6) AS millis_share FROM t",
    "survey_byte_entropy": """WITH h AS (SELECT hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT h[2 * i + 1 : 2 * i + 2] AS b FROM (SELECT h, unnest(range(0, length(h) // 2)) AS i FROM h)), p AS (SELECT count(*) AS k, count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY b)
SELECT (SELECT count(*) FROM h) AS observations, sum(k)::BIGINT AS total_bytes, round(-sum(p * log2(p)), 6) AS entropy_bits, CASE WHEN -sum(p * log2(p)) >= 7.5 THEN 'Compressed' WHEN -sum(p * log2(p)) >= 5 THEN 'MixedHighEntropy' WHEN -sum(p * log2(p)) >= 2 THEN 'Structured' ELSE 'LowEntropy' END AS class FROM p""",
    "survey_type_tags": "SELECT CASE WHEN json_extract(props, '$.k') IS NULL THEN 'ABSENT' WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.k') END AS tag, count(*) AS n FROM events GROUP BY 1",
    "cross_pearson": "SELECT count(*) AS n, round(corr(l_extendedprice, l_quantity), 5) AS r, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept FROM lineitem",
    "cross_cramers_v": """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS k FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(k) AS ra FROM c GROUP BY a), s AS (SELECT b, sum(k) AS cb FROM c GROUP BY b), n AS (SELECT sum(k) AS n FROM c),
g AS (SELECT r.a, s.b, coalesce(c.k, 0) AS k, ra * cb / n AS e, n FROM r CROSS JOIN s CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = s.b)
SELECT max(n)::BIGINT AS n, round(sum((k - e) ** 2 / e), 5) AS chi2, round(sqrt(sum((k - e) ** 2 / e) / (max(n) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) - 1))), 5) AS cramers_v, round(sum(CASE WHEN k > 0 THEN k / n * log2(k / e) ELSE 0 END), 5) AS mutual_information FROM g""",
    "cross_eta_squared": """WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), m AS (SELECT g, count(*) AS k, avg(x) AS m FROM x GROUP BY g), t AS (SELECT avg(x) AS mean, sum((x - (SELECT avg(x) FROM x)) ** 2) AS sst, count(*) AS n FROM x)
SELECT max(n) AS n, count(*) AS groups, round(sum(k * (m - mean) ** 2) / max(sst), 6) AS eta_squared FROM m, t""",
    "cross_functional_dep": " UNION ALL ".join(f"SELECT sum(k)::BIGINT AS n, round(sum(best) / sum(k), 6) AS support, count(*) AS determinants, count(*) FILTER (v = 1) AS deterministic FROM (SELECT {a}, max(k) AS best, sum(k) AS k, count(*) AS v FROM (SELECT {a}, {b}, count(*) AS k FROM {t} GROUP BY ALL) GROUP BY {a})" for t, a, b in (("nation", "n_nationkey", "n_regionkey"), ("part", "p_brand", "p_type"))),
    "cross_copresence": f"""WITH {_O}, c AS (SELECT count(*) FILTER (o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL) AS both_, count(*) FILTER (o_custkey IS NOT NULL AND o_orderpriority IS NULL) AS a_only, count(*) FILTER (o_custkey IS NULL AND o_orderpriority IS NOT NULL) AS b_only, count(*) FILTER (o_custkey IS NULL AND o_orderpriority IS NULL) AS neither FROM o)
SELECT both_ AS "both", a_only, b_only, neither, round(both_ / (both_ + a_only + b_only), 6) AS jaccard, round(both_ / (both_ + b_only), 6) AS a_given_b, round(both_ / (both_ + a_only), 6) AS b_given_a FROM c""",
    "cross_trend": "SELECT count(*) AS n, round(corr(o_totalprice, o_orderkey), 6) AS r, round(regr_slope(o_totalprice, o_orderkey), 6) AS slope FROM orders",
}
