"""Many predicates evaluated over one scan of the records, and what their results say."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import predicate as P


def evaluate_predicates(records: DataFrame, preds: dict[int, P.Pred | P.Node], ordinal: str, limit: int | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """(pred_id, ordinal) of every match: all predicates are columns of one pass, and only matches leave it.

    ``window`` is a range of ordinals that the scan can prune by; ``limit`` keeps the first matches of
    each predicate.
    """
    if window:
        records = records.where((F.col(ordinal) >= window[0]) & (F.col(ordinal) < window[1]))
    if not preds:
        return records.select(F.lit(None).cast("int").alias("pred_id"), F.col(ordinal).alias("ordinal")).limit(0)
    hits = F.array(*[F.when(P.to_column(p, records.schema), F.lit(i)) for i, p in preds.items()])
    out = records.select(F.explode(F.array_compact(hits)).alias("pred_id"), F.col(ordinal).alias("ordinal"))
    if limit is None:
        return out
    w = Window.partitionBy("pred_id").orderBy("ordinal")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def evaluate_int_eq(records: DataFrame, preds: DataFrame, record_cols: list[str], pred_cols: list[str], ordinal: str) -> DataFrame:
    """(pred_id, ordinal) where the predicates' integer columns equal the records': an equi-join instead of a test per predicate."""
    r = records.select(F.col(ordinal).alias("ordinal"), *[F.col(c).cast("long").alias(f"_k{i}") for i, c in enumerate(record_cols)])
    p = preds.select("pred_id", *[F.col(c).cast("long").alias(f"_k{i}") for i, c in enumerate(pred_cols)])
    return r.join(p, [f"_k{i}" for i in range(len(record_cols))]).select("pred_id", "ordinal")


def counts(results: DataFrame, pred_ids: list[int]) -> DataFrame:
    """(pred_id, n): matches of each predicate, 0 included."""
    ids = results.sparkSession.createDataFrame([(i,) for i in pred_ids], "pred_id int")
    n = results.groupBy("pred_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(n, "pred_id", "left").na.fill(0, ["n"])


def guard(results: DataFrame, pred_ids: list[int], allow_empty: bool = False) -> DataFrame:
    """The results, after a check that no more than half of the predicates match nothing."""
    empty = counts(results, pred_ids).where("n = 0").count()
    if empty * 2 > len(pred_ids) and not allow_empty:
        raise ValueError(f"{empty} of {len(pred_ids)} predicates match nothing")
    return results


def predicate_summary(results: DataFrame, preds: dict[int, P.Pred | P.Node], n_records: int, target: float | None = None, tolerance: float = 0.2) -> DataFrame:
    """(measure, key, value): least, median, 95th percentile and greatest match count by nearest index, predicates that match none or all, comparisons by field and by operator, and how many miss the target selectivity."""
    n = counts(results, list(preds))
    total = len(preds)
    at = n.withColumn("i", F.row_number().over(Window.orderBy("n", "pred_id")) - 1)  # a row per predicate
    places = {"min": 0, "median": round(0.5 * (total - 1)), "p95": round(0.95 * (total - 1)), "max": total - 1}
    named = at.agg(
        *[F.max(F.when(F.col("i") == k, F.col("n"))).cast("double").alias(m) for m, k in places.items()],
        F.count_if(F.col("n") == 0).cast("double").alias("zero"),
        F.count_if(F.col("n") == n_records).cast("double").alias("all"),
        *([F.count_if(F.abs(F.col("n") / n_records - target) > tolerance * target).cast("double").alias("off_target")] if target else []),
    )
    out = named.unpivot([], named.columns, "key", "value").select(F.lit("matches").alias("measure"), "key", "value")
    tally: dict[tuple[str, str], int] = {}
    for p in preds.values():
        for leaf in P.leaves(p):
            for k in (("field", str(leaf.field)), ("op", leaf.op)):
                tally[k] = tally.get(k, 0) + 1
    more = results.sparkSession.createDataFrame([(a, b, float(c)) for (a, b), c in tally.items()], out.schema)
    return out.unionByName(more)


def explain_predicate(records: DataFrame, results: DataFrame, preds: dict[int, P.Pred | P.Node], pred_id: int, ordinal: str, sample: int = 10) -> DataFrame:
    """(predicate, ordinal, record as JSON, agrees): the first matches of a predicate, tested again."""
    p = preds[pred_id]
    own = results.where(F.col("pred_id") == pred_id).select(F.col("ordinal").alias("_o")).orderBy("_o").limit(sample)
    rows = records.join(own, records[ordinal] == own["_o"])
    return rows.select(F.lit(P.display(p)).alias("predicate"), F.col("_o").alias("ordinal"), F.to_json(F.struct(*[records[c] for c in records.columns])).alias("record"), P.to_column(p, records.schema).alias("agrees"))


def explain_ordinal(results: DataFrame, preds: dict[int, P.Pred | P.Node], at: int) -> DataFrame:
    """(pred_id, predicate): the predicates that a record satisfies."""
    names = results.sparkSession.createDataFrame([(i, P.display(p)) for i, p in preds.items()], "pred_id int, predicate string")
    return results.where(F.col("ordinal") == at).select("pred_id").join(names, "pred_id")


def verify_predicates(records: DataFrame, results: DataFrame, preds: dict[int, P.Pred | P.Node], ordinal: str, step: int = 1) -> DataFrame:
    """(pred_id, matches, missing, extra): results against Spark's own SQL of each predicate, on every ``step``-th record."""
    rows = records.where(F.col(ordinal) % step == 0)
    hits = F.array(*[F.when(F.expr(P.to_sql(p)), F.lit(i)) for i, p in preds.items()])
    want = rows.select(F.explode(F.array_compact(hits)).alias("pred_id"), F.col(ordinal).alias("ordinal"), F.lit(1).alias("w"))
    got = results.where(F.col("ordinal") % step == 0).withColumn("g", F.lit(1))
    both = want.join(got, ["pred_id", "ordinal"], "full").groupBy("pred_id")
    return both.agg(F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("matches"), F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"))


def record_fingerprint(records: DataFrame, json_col: str) -> DataFrame:
    """(structure, n): the types of JSON records without their values, and how many records have each."""
    return records.groupBy(F.schema_of_variant(F.try_parse_json(json_col)).alias("structure")).agg(F.count(F.lit(1)).alias("n"))


def render(row: dict, style: str, table: str = "record", schema: T.StructType | None = None) -> str:
    """A record in one of the text forms: json, jsonl, yaml, readout, display, sql, sqlite, cql, cddl; with ``_schema`` the statement that declares it."""
    names = list(row)
    if style in ("json", "jsonl"):
        return json.dumps(row, indent=2 if style == "json" else None, default=str, ensure_ascii=False)
    if style == "yaml":
        return "\n".join(f"{k}: {json.dumps(v, default=str, ensure_ascii=False)}" for k, v in row.items())
    if style == "readout":
        wide = max(map(len, names), default=0)
        return "\n".join(f"{k.ljust(wide)} : {v}" for k, v in row.items())
    if style == "display":
        return "{" + ", ".join(f"{k}: {P._sql_value(v)}" for k, v in row.items()) + "}"
    if style in ("sql", "sqlite", "cql"):
        return f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join(P._sql_value(v) for v in row.values())});"
    kinds = {
        "sql": {"text": "VARCHAR", "number": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "bytes": "VARBINARY", "null": "VARCHAR"},
        "sqlite": {"text": "TEXT", "number": "INTEGER", "float": "REAL", "bool": "INTEGER", "bytes": "BLOB", "null": "TEXT"},
        "cql": {"text": "text", "number": "bigint", "float": "double", "bool": "boolean", "bytes": "blob", "null": "text"},
        "cddl": {"text": "tstr", "number": "int", "float": "float", "bool": "bool", "bytes": "bstr", "null": "null"},
    }
    dialect = style.removesuffix("_schema").removesuffix("_value")
    if dialect not in kinds:
        raise ValueError(f"unknown style {style!r}")
    kind = {k: kinds[dialect]["float" if isinstance(v, float) else P._value_family(v)] for k, v in row.items()}
    if style == "cddl":
        return f"{table} = {{ {', '.join(f'{k}: {t}' for k, t in kind.items())} }}"
    if style == "cddl_value":
        return f"{table} = {{ {', '.join(f'{k}: {json.dumps(v, default=str)}' for k, v in row.items())} }}"
    if style.endswith("_schema"):
        return f"CREATE TABLE {table} ({', '.join(f'{k} {t}' for k, t in kind.items())});"
    raise ValueError(f"unknown style {style!r}")


def parse_record(text: str, style: str) -> dict:
    """A record from json, jsonl, yaml (flat) or readout text."""
    if style in ("json", "jsonl"):
        return json.loads(text)
    sep = ":"
    out = {}
    for line in text.splitlines():
        k, _, v = line.partition(sep)
        v = v.strip()
        if style == "yaml":
            out[k.strip()] = json.loads(v)
        else:
            out[k.strip()] = v
    return out
