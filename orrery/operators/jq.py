"""Queries over JSON records: a bounded jq compiled to columns over VARIANT.

A program is stages joined by ``|``. A stage is ``.``, a path, paths joined by commas (an object of
them), ``select(path op value)``, ``length``, ``keys``, ``.[]``, ``map(path)``, an object ``{a: .x, b}``,
``if path op value then path else path end`` or ``group_by(path)`` on whole records. A record whose path
is missing drops out. Numbers compare as doubles, texts by bytes; other types are never ordered.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATH = re.compile(r"\.(?:[A-Za-z_]\w*(?:\[\d+\])?(?:\.[A-Za-z_]\w*(?:\[\d+\])?)*)?")


def _json_path(path: str) -> str:
    if not _PATH.fullmatch(path):
        raise ValueError(f"cannot read the path {path!r}")
    return "$" if path == "." else "$" + path


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, _json_path(path), kind)


def _tag(v: Column) -> Column:
    return F.schema_of_variant(v)


def condition(v: Column, text: str) -> Column:
    """``path op literal`` as a Boolean that is never null."""
    m = re.fullmatch(r"\s*(\.\S*?)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*", text)
    if not m:
        raise ValueError(f"cannot read the condition {text!r}")
    path, op, want = m[1], m[2], json.loads(m[3])
    here = at(v, path)
    tag = _tag(here)
    if isinstance(want, bool):
        left, same_kind = at(v, path, "boolean"), tag == "BOOLEAN"
    elif isinstance(want, (int, float)):
        left, same_kind, want = at(v, path, "double"), tag.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), float(want)
    elif isinstance(want, str):
        left, same_kind = at(v, path, "string"), tag == "STRING"
    elif want is None:
        null = F.coalesce(F.is_variant_null(here), F.lit(False))
        return {"==": null, "!=": ~null & here.isNotNull()}.get(op, F.lit(False))
    else:
        raise ValueError("only single values can be compared")
    x = F.lit(want)
    if op in ("==", "!="):
        equal = F.coalesce(same_kind & (left == x), F.lit(False))
        return equal if op == "==" else ~equal & here.isNotNull()
    if isinstance(want, bool):
        return F.lit(False)
    return F.coalesce(same_kind & {">": left > x, "<": left < x, ">=": left >= x, "<=": left <= x}[op], F.lit(False))


def _object(v: Column, fields: list[tuple[str, str]]) -> Column:
    return F.to_variant_object(F.struct(*[at(v, p).alias(n) for n, p in fields]))


def _split(text: str, sep: str) -> list[str]:
    """Split where no bracket or quote is open."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "([{":
            depth += 1
        elif not quoted and c in ")]}":
            depth -= 1
        elif not quoted and not depth and c == sep:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in (*out, text[start:])]


def stage(df: DataFrame, text: str) -> DataFrame:
    """One stage on a table of ``v VARIANT``."""
    v = F.col("v")
    if text == ".":
        return df
    if text == "length":
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.try_parse_json(F.col("n").cast("string")).alias("v"))
    if text == "keys":
        return df.select(F.try_parse_json(F.to_json(F.sort_array(F.json_object_keys(F.to_json(v))))).alias("v")).where("v IS NOT NULL")
    if m := re.fullmatch(r"(\.\S*?)?\.?\[\]", text):
        inner = at(v, m[1] or ".", "array<variant>")
        return df.select(F.explode(inner).alias("v"))
    if m := re.fullmatch(r"map\((\..*)\)", text):
        inner = at(v, ".", "array<variant>")
        return df.select(F.try_parse_json(F.to_json(F.transform(inner, lambda x: at(x, m[1])))).alias("v"))
    if m := re.fullmatch(r"select\((.*)\)", text):
        return df.where(condition(v, m[1]))
    if m := re.fullmatch(r"if (.*) then (\.\S*) else (\.\S*) end", text):
        return df.select(F.when(condition(v, m[1]), at(v, m[2])).otherwise(at(v, m[3])).alias("v"))
    if m := re.fullmatch(r"group_by\((\..*)\)", text):
        key = F.to_json(at(v, m[1]))
        return df.groupBy(key.alias("k")).agg(F.sort_array(F.collect_list(F.to_json(v))).alias("g")).select(F.try_parse_json(F.concat(F.lit("["), F.array_join("g", ","), F.lit("]"))).alias("v"))
    if text.startswith("{") and text.endswith("}"):
        fields = []
        for part in _split(text[1:-1], ","):
            name, _, path = part.partition(":")
            fields.append((name.strip(), path.strip() or "." + name.strip()))
        return df.select(_object(v, fields).alias("v"))
    parts = _split(text, ",")
    if len(parts) > 1:
        # A missing key is left out of the object; a JSON null stays.
        return df.select(F.try_parse_json(F.to_json(F.struct(*[at(v, p).alias(p.rsplit(".", 1)[1]) for p in parts]))).alias("v"))
    return df.select(at(v, text).alias("v")).where("v IS NOT NULL")


def jq(df: DataFrame, json_col: str, program: str) -> DataFrame:
    """(v) as JSON text; records that are no JSON are dropped."""
    out = df.select(F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    for text in _split(program, "|"):
        out = stage(out, text)
    return out.select(F.to_json("v").alias("v"))


def read_jsonl(spark, path: str) -> DataFrame:
    """(value) of every line that is not blank, for jq()."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)
