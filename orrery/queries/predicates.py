"""Predicates over ``orders`` and JSON records in ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import predicate as P
from orrery.operators import predicates as ops
from orrery.session import table

PREDS = {
    0: P.parse("o_totalprice > 300000.0"),
    1: P.parse("o_orderstatus = 'F' AND o_totalprice <= 50000.0"),
    2: P.parse("o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice < 1000.0 OR o_totalprice >= 400000.0)"),
    3: P.parse("o_orderpriority MATCHES ('LOW', 'SPEC')"),
    4: P.parse("o_orderstatus != 'O'"),
    5: P.parse("o_custkey = NULL"),
    6: P.parse("o_custkey != NULL AND o_orderkey < 100"),
    7: P.parse("nothing_like_it = NULL AND o_orderkey = 1"),
    8: P.parse("o_orderstatus > 5"),
    9: P.parse("[1] >= 1400"),
}
#: The predicates that plain SQL over the table can state: all but those on a missing field, across families, and by position.
PLAIN = {i: p for i, p in PREDS.items() if i not in (7, 8, 9)}


def orders(spark: SparkSession, sf: str) -> DataFrame:
    # A tenth of customers is blanked, so that there are missing values.
    return table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")))


def _evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.evaluate_predicates(orders(spark, sf), PREDS, "o_orderkey")


def _int_eq(spark: SparkSession, sf: str) -> DataFrame:
    preds = spark.range(40).select(F.col("id").cast("int").alias("pred_id"), (F.col("id") % 10).alias("v"))
    return ops.evaluate_int_eq(table(spark, sf, "embeddings"), preds, ["label"], ["v"], "vec_id")


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    return ops.predicate_summary(_evaluate(spark, sf), PREDS, rows.count(), target=0.1)


def _explain(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.explain_predicate(orders(spark, sf), _evaluate(spark, sf), PREDS, 1, "o_orderkey")
    return out.select("predicate", "ordinal", F.get_json_object("record", "$.o_orderstatus").alias("status"), "agrees")


def _verify(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    return ops.verify_predicates(rows, ops.evaluate_predicates(rows, PLAIN, "o_orderkey"), PLAIN, "o_orderkey")


QUERIES = {
    "evaluate_predicates": _evaluate,
    "evaluate_predicates_int_eq": _int_eq,
    "predicate_summary": _summary,
    "explain_predicate": _explain,
    "explain_ordinal": lambda s, sf: ops.explain_ordinal(_evaluate(s, sf), PREDS, 1).select("pred_id"),
    "verify_predicates": _verify,
    "record_fingerprint": lambda s, sf: ops.record_fingerprint(table(s, sf, "events"), "props"),
}

_O = "o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS o_custkey) FROM orders)"
_WHERE = {i: P.to_sql(p) for i, p in PLAIN.items()} | {7: "o_orderkey = 1", 8: "FALSE", 9: "coalesce(o_custkey >= 1400, FALSE)"}
_R = "r AS (" + " UNION ALL ".join(f"SELECT {i} AS pred_id, o_orderkey AS ordinal FROM o WHERE {w}" for i, w in _WHERE.items()) + ")"
_LEAVES = [x for p in PREDS.values() for x in P.leaves(p)]
_TALLY = ", ".join(f"('{m}', '{k}', {n}::DOUBLE)" for m, keys in (("field", [str(x.field) for x in _LEAVES]), ("op", [x.op for x in _LEAVES])) for k in dict.fromkeys(keys) for n in [keys.count(k)])

ORACLES = {
    "evaluate_predicates": f"WITH {_O}, {_R} SELECT pred_id::INT AS pred_id, ordinal FROM r",
    "evaluate_predicates_int_eq": "SELECT p::INT AS pred_id, vec_id AS ordinal FROM range(40) AS r(p) JOIN embeddings ON label = p % 10",
    "predicate_summary": f"""WITH {_O}, {_R}, n AS (SELECT p AS pred_id, (SELECT count(*) FROM r WHERE r.pred_id = p) AS n FROM range({len(PREDS)}) AS t(p)),
i AS (SELECT *, row_number() OVER (ORDER BY n, pred_id) - 1 AS i FROM n), c AS (SELECT count(*) AS c FROM o)
SELECT 'matches' AS measure, key, value::DOUBLE AS value FROM (
SELECT 'min' AS key, min(n) AS value FROM n UNION ALL SELECT 'max', max(n) FROM n UNION ALL SELECT 'median', n FROM i WHERE i = {round(0.5 * (len(PREDS) - 1))} UNION ALL SELECT 'p95', n FROM i WHERE i = {round(0.95 * (len(PREDS) - 1))}
UNION ALL SELECT 'zero', count(*) FILTER (n = 0) FROM n UNION ALL SELECT 'all', count(*) FILTER (n = c) FROM n, c UNION ALL SELECT 'off_target', count(*) FILTER (abs(n / c - 0.1) > 0.2 * 0.1) FROM n, c)
UNION ALL SELECT * FROM (VALUES {_TALLY}) AS v(measure, key, value)""",
    "explain_predicate": f"WITH {_O}, {_R} SELECT '{P.display(PREDS[1]).replace(chr(39), chr(39) * 2)}' AS predicate, ordinal, o_orderstatus AS status, true AS agrees FROM r JOIN o ON o_orderkey = ordinal WHERE pred_id = 1 ORDER BY ordinal LIMIT 10",
    "explain_ordinal": f"WITH {_O}, {_R} SELECT pred_id::INT AS pred_id FROM r WHERE ordinal = 1",
    "verify_predicates": f"WITH {_O}, {_R} SELECT pred_id::INT AS pred_id, count(*) AS matches, 0::BIGINT AS missing, 0::BIGINT AS extra FROM r WHERE pred_id IN ({', '.join(map(str, PLAIN))}) GROUP BY 1",
    "record_fingerprint": """WITH k AS (SELECT event_id, string_agg(k || ': ' || CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.' || k) END, ', ' ORDER BY k) AS s
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id)
SELECT 'OBJECT<' || s || '>' AS structure, count(*) AS n FROM k GROUP BY 1""",
}
