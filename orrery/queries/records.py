"""JSON queries, catalogs, Merkle trees, record statistics and synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.predicate import display
from orrery.operators import catalog, jq, merkle, records, synth
from orrery.queries.vectors import rounded
from orrery.session import table

def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as nested JSON records; every fifth lacks the inner object."""
    e = table(spark, sf, "events")
    inner = F.when(F.col("event_id") % 5 != 0, F.struct((F.col("user_id") % 7).alias("b"), F.array(F.lit(1), (F.col("event_id") % 3).cast("int")).alias("l")))
    return e.select(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), inner.alias("a"))).alias("doc"))


def _jq(program: str):
    return lambda spark, sf: jq.jq(events(spark, sf), "doc", program)


def _field(program: str, **paths: str):
    """A query's objects as columns, as the order of keys is no part of a JSON value."""
    return lambda spark, sf: jq.jq(events(spark, sf), "doc", program).select(*[F.get_json_object("v", p).alias(n) for n, p in paths.items()])


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog made of suppliers: name, metric, type, size and facets."""
    k = F.col("s_suppkey")
    metric = F.element_at(F.array(*map(F.lit, ("L2", "COSINE", "IP", "EUCLIDEAN"))), (k % 4 + 1).cast("int"))
    facets = F.when(k % 2 == 0, F.array(F.lit("base"), F.lit("query"))).otherwise(F.array(F.lit("base"), F.lit("metadata")))
    return table(spark, sf, "supplier").select(F.concat(F.lit("set-"), k.cast("string")).alias("name"), metric.alias("metric"), F.when(k % 3 == 0, "u8").otherwise("f32").alias("vtype"), (k % 8 * 64 + 64).alias("dim"), (k * 1000).alias("count"), facets.alias("facets"))


def variables(spark: SparkSession, sf: str) -> DataFrame:
    d = datasets(spark, sf)
    parts = [d.select(F.col("name").alias("dataset_name"), F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in (("dim", F.col("dim")), ("vector_count", F.col("count")), ("distance_function", F.col("metric")))]
    own = d.where("dim > 300").select(F.col("name").alias("dataset_name"), F.lit("a_note").alias("key"), F.lit("wide").alias("value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(own)


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.merkle_chunks(table(spark, sf, "documents"), "doc_id", "text", 1024)


def _merkle_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Against the same texts with their 1,500th character doubled, where they are that long."""
    d = table(spark, sf, "documents")
    other = d.withColumn("text", F.when(F.length("text") > 1500, F.concat(F.substring("text", 1, 1500), F.substring("text", 1500, 1), F.substr("text", F.lit(1501)))).otherwise(F.col("text")))
    return merkle.merkle_diff(leaves(spark, sf), merkle.merkle_chunks(other, "doc_id", "text", 1024)).groupBy("key", "change").agg(F.count(F.lit(1)).alias("n"))


def _numeric(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = [(display(p), "numeric") for p in synth.numeric_predicates(table(spark, sf, "orders"), "o_custkey", 0.05) + synth.numeric_predicates(li, "l_quantity", 0.1)]
    return spark.createDataFrame(rows, "predicate string, kind string")


def _categorical(spark: SparkSession, sf: str) -> DataFrame:
    preds = [synth.categorical_predicate(table(spark, sf, "part"), "p_brand", 0.05), synth.categorical_predicate(table(spark, sf, "orders"), "o_orderstatus", 0.3)]
    return spark.createDataFrame([(display(p),) for p in preds], "predicate string")


def _trigram(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(display(synth.trigram_predicate(table(spark, sf, "part"), "p_type", 0.3)),)], "predicate string")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return synth.generate_vectors(spark, 1000, 16, seed=7, normalize=True, zeros=3, duplicates=5)


def _records(program: str):
    return lambda spark, sf: records.query_records(events(spark, sf), "doc", program)


QUERIES = {
    "records_arithmetic": _records(".event_id + (.a.b // 0) * 2"),
    "records_logic": _records('select(.a.b == 1 and .kind != "click" or .a == null) | .event_id'),
    "records_map": _records("(.a.l // []) | map(. + 1) | add // 0"),
    "records_object": lambda s, sf: _records("{id: .event_id, k: (.a.b | tostring), n: (.kind | length)}")(s, sf).select(*[F.get_json_object("v", f"$.{c}").alias(c) for c in ("id", "k", "n")]),
    "records_length": _records("[(.a.l // [] | length), (.kind | length), (keys | length)]"),
    "records_reduce": _records("reduce (.a.l // [])[] as $x (0; . + $x * $x)"),
    "records_interpolation": _records('"\\(.kind)-\\(.event_id % 4)"'),
    "records_update": _records(".a.b |= (. // -1) | .a.b"),
    "jq_path": _jq(".a.b"),
    "jq_multi": _field(".kind, .a.b", kind="$.kind", b="$.b"),
    "jq_select": _field('select(.kind == "click") | select(.a.b >= 3)', event_id="$.event_id", b="$.a.b"),
    "jq_length": _jq("select(.a.b < 2) | length"),
    "jq_iterate": _jq(".a.l | .[]"),
    "jq_construct": _field("{id: .event_id, inner: .a.b}", id="$.id", inner="$.inner"),
    "jq_keys": _jq("keys"),
    "jq_condition": _jq("if .a.b > 3 then .kind else .event_id end"),
    "catalog_stats": lambda s, sf: catalog.catalog_stats(variables(s, sf)),
    "catalog_filter": lambda s, sf: catalog.catalog_filter(datasets(s, sf), name="set-*1", facet="metadata", metric="euclidean", dim=(64, 400)).select("name", "metric", "dim"),
    "catalog_distinct": lambda s, sf: catalog.distinct_values(datasets(s, sf)),
    "slab_stats": lambda s, sf: rounded(catalog.record_stats(table(s, sf, "events"), "props"), "mean", "utilisation"),
    "merkle_chunks": leaves,
    "merkle_summary": lambda s, sf: merkle.merkle_summary(leaves(s, sf)).select("key", "chunks", "bytes", "root"),
    "merkle_diff": _merkle_diff,
    "merkle_verify": lambda s, sf: merkle.merkle_verify(table(s, sf, "documents"), merkle.spoil(leaves(s, sf), 7), "doc_id", "text", 1024),
    "predicates_numeric": _numeric,
    "predicates_categorical": _categorical,
    "predicates_trigram": _trigram,
    "generate_vectors": _vectors,
    "generate_metadata": lambda s, sf: synth.generate_metadata(s, 1000, {"age": (1, 100), "score": (1, 50)}, 42),
}

_E = "e AS (SELECT event_id, event_type AS kind, CASE WHEN event_id % 5 <> 0 THEN user_id % 7 END AS b, event_id % 3 AS l, event_id % 5 <> 0 AS has FROM events)"
_DS = "ds AS (SELECT 'set-' || s_suppkey AS name, ['L2', 'COSINE', 'IP', 'EUCLIDEAN'][s_suppkey % 4 + 1] AS metric, CASE WHEN s_suppkey % 3 = 0 THEN 'u8' ELSE 'f32' END AS vtype, s_suppkey % 8 * 64 + 64 AS dim, s_suppkey * 1000 AS count, CASE WHEN s_suppkey % 2 = 0 THEN ['base', 'query'] ELSE ['base', 'metadata'] END AS facets FROM supplier)"
_BYTES = "h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0)"
_LEAF = f"{_BYTES}, lf AS (SELECT doc_id AS key, c AS chunk, least(1024, length(h) // 2 - c * 1024) AS size, sha256(unhex(substr(h, 2048 * c + 1, 2048))) AS hash FROM (SELECT *, unnest(range(0, (length(h) // 2 + 1023) // 1024)) AS c FROM h))"
_ALTERED = "CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || substr(text, 1500, 1) || substr(text, 1501) ELSE text END"

ORACLES = {
    "records_arithmetic": f"WITH {_E} SELECT (event_id + coalesce(b, 0) * 2)::VARCHAR AS v FROM e",
    "records_logic": f"WITH {_E} SELECT event_id::VARCHAR AS v FROM e WHERE coalesce(b = 1, false) AND kind <> 'click' OR NOT has",
    "records_map": f"WITH {_E} SELECT (CASE WHEN has THEN 2 + l + 1 ELSE 0 END)::VARCHAR AS v FROM e",
    "records_object": f"WITH {_E} SELECT event_id::VARCHAR AS id, coalesce(b::VARCHAR, 'null') AS k, length(kind)::VARCHAR AS n FROM e",
    "records_length": f"WITH {_E} SELECT '[' || (CASE WHEN has THEN 2 ELSE 0 END) || ',' || length(kind) || ',' || (CASE WHEN has THEN 3 ELSE 2 END) || ']' AS v FROM e",
    "records_reduce": f"WITH {_E} SELECT (CASE WHEN has THEN 1 + l * l ELSE 0 END)::VARCHAR AS v FROM e",
    "records_interpolation": f"""WITH {_E} SELECT '"' || kind || '-' || event_id % 4 || '"' AS v FROM e""",
    "records_update": f"WITH {_E} SELECT coalesce(b, -1)::VARCHAR AS v FROM e",
    "jq_path": f"WITH {_E} SELECT b::VARCHAR AS v FROM e WHERE has",
    "jq_multi": f"WITH {_E} SELECT kind, b::VARCHAR AS b FROM e",
    "jq_select": f"WITH {_E} SELECT event_id::VARCHAR AS event_id, b::VARCHAR AS b FROM e WHERE kind = 'click' AND b >= 3",
    "jq_length": f"WITH {_E} SELECT count(*)::VARCHAR AS v FROM e WHERE b < 2",
    "jq_iterate": f"WITH {_E} SELECT unnest([1, l])::VARCHAR AS v FROM e WHERE has",
    "jq_construct": f"WITH {_E} SELECT event_id::VARCHAR AS id, b::VARCHAR AS inner FROM e".replace("AS inner", 'AS "inner"'),
    "jq_keys": f"""WITH {_E} SELECT CASE WHEN has THEN '["a","event_id","kind"]' ELSE '["event_id","kind"]' END AS v FROM e""",
    "jq_condition": f"""WITH {_E} SELECT CASE WHEN b > 3 THEN '"' || kind || '"' ELSE event_id::VARCHAR END AS v FROM e""",
    "catalog_stats": f"WITH {_DS} SELECT name AS dataset_name, dim::VARCHAR AS dim, count::VARCHAR AS vector_count, metric AS distance_function, CASE WHEN dim > 300 THEN 'wide' ELSE '' END AS a_note FROM ds",
    "catalog_filter": f"WITH {_DS} SELECT name, metric, dim FROM ds WHERE name LIKE 'set-%1' AND list_contains(facets, 'metadata') AND metric IN ('L2', 'EUCLIDEAN') AND dim BETWEEN 64 AND 400",
    "catalog_distinct": f"WITH {_DS} SELECT DISTINCT 'metric' AS kind, metric AS value FROM ds UNION SELECT 'vtype', vtype FROM ds UNION SELECT 'dim', dim::VARCHAR FROM ds UNION SELECT 'facet', unnest(facets) FROM ds",
    "slab_stats": """WITH a AS (SELECT count(*) AS records, sum(strlen(props))::BIGINT AS bytes, min(strlen(props))::INT AS min, max(strlen(props))::INT AS max, avg(strlen(props)) AS mean FROM events), p AS (SELECT *, ceil((bytes + 4 * records) / (65536 - 28))::BIGINT AS pages FROM a)
SELECT records, bytes, min, max, round(mean, 6) AS mean, pages, round(bytes / (pages * 65536), 6) AS utilisation FROM p""",
    "merkle_chunks": f"WITH {_LEAF} SELECT key, chunk::INT AS chunk, size::INT AS size, hash FROM lf",
    "merkle_verify": f"WITH {_LEAF} SELECT key, chunk::INT AS chunk, 'changed' AS change FROM lf WHERE chunk % 7 = 0",
    "merkle_diff": f"""WITH {_LEAF}, h2 AS (SELECT doc_id, hex(encode({_ALTERED})) AS h FROM documents WHERE length(text) > 0), lf2 AS (SELECT doc_id AS key, c AS chunk, sha256(unhex(substr(h, 2048 * c + 1, 2048))) AS hash FROM (SELECT *, unnest(range(0, (length(h) // 2 + 1023) // 1024)) AS c FROM h2))
SELECT key, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM (SELECT key, chunk, hash FROM lf) a FULL JOIN lf2 b USING (key, chunk) WHERE a.hash IS DISTINCT FROM b.hash GROUP BY ALL""",
    "predicates_numeric": """SELECT 'o_custkey <= ' || quantile_disc(o_custkey, 0.05) AS predicate, 'numeric' AS kind FROM orders UNION ALL SELECT 'o_custkey >= ' || quantile_disc(o_custkey, 0.95), 'numeric' FROM orders
UNION ALL SELECT 'l_quantity < ' || quantile_disc(l_quantity, 0.1), 'numeric' FROM lineitem UNION ALL SELECT 'l_quantity > ' || quantile_disc(l_quantity, 0.9), 'numeric' FROM lineitem""",
    "predicates_categorical": """WITH a AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), b AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
(SELECT 'p_brand = ''' || v || '''' AS predicate FROM a ORDER BY abs(n - 0.05 * (SELECT sum(n) FROM a)), v LIMIT 1) UNION ALL (SELECT 'o_orderstatus = ''' || v || '''' FROM b ORDER BY abs(n - 0.3 * (SELECT sum(n) FROM b)), v LIMIT 1)""",
    "predicates_trigram": """WITH g AS (SELECT DISTINCT p_partkey, substr(p_type, i, 3) AS g FROM (SELECT p_partkey, p_type, unnest(range(1, length(p_type) - 1)) AS i FROM part)), n AS (SELECT g, count(*) AS n FROM g GROUP BY g ORDER BY n DESC, g LIMIT 1024)
SELECT 'p_type MATCHES (''' || g || ''')' AS predicate FROM n ORDER BY abs(n - 0.3 * (SELECT count(*) FROM part)), g LIMIT 1""",
}
