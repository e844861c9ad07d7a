"""Catalogs of data sets: one row per data set and profile, looked up, filtered and reported."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vec

#: Fixed order of the columns that come first in a report; all others follow by name.
PRIORITY = [
    "dataset_name", "dim", "query_count", "vector_count", "duplicate_count", "zero_count", "base_count", "distance_function",
    "source_was_normalized", "source_mean_normal_epsilon", "source_max_normal_epsilon", "source_min_normal_epsilon", "is_normalized",
    "output_mean_normal_epsilon", "output_max_normal_epsilon", "output_min_normal_epsilon", "normal_threshold", "clean_count",
    "extract_input_count", "extract_output_count", "knn_queries_with_ties", "knn_tied_neighbors", "mean_normal_epsilon", "max_normal_epsilon", "min_normal_epsilon",
]


def catalog_stats(variables: DataFrame) -> DataFrame:
    """A row per data set from (dataset_name, key, value): known columns first, others by name, blanks for what is missing."""
    keys = [r["key"] for r in variables.select("key").distinct().collect()]  # names of variables: tens
    order = [k for k in PRIORITY if k in keys] + sorted(set(keys) - set(PRIORITY))
    return variables.groupBy("dataset_name").pivot("key", order).agg(F.first("value")).na.fill("", order)


def name_matches(c: Column, pattern: str) -> Column:
    """A pattern between slashes is a regular expression, one with * or ? a glob, any other a part of the name; case is ignored."""
    low = F.lower(c)
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return low.rlike(pattern[1:-1].lower())
    if any(x in pattern for x in "*?"):
        return low.rlike("^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in pattern.lower()) + "$")
    return low.contains(pattern.lower())


def catalog_filter(catalog: DataFrame, name: str | None = None, facet: str | None = None, metric: str | None = None, vtype: str | None = None, dim: tuple[int, int] | None = None, count: tuple[int, int] | None = None) -> DataFrame:
    """Rows of (name, metric, vtype, dim, count, facets ARRAY) that meet every condition given; ranges include both ends, a metric goes by any of its names."""
    out = catalog
    if name is not None:
        out = out.where(name_matches(F.col("name"), name))
    if facet is not None:
        out = out.where(F.array_contains("facets", facet))
    if metric is not None:
        same = [k for k, v in vec.METRICS.items() if v == vec.metric_name(metric)]
        out = out.where(F.upper("metric").isin(same))
    if vtype is not None:
        out = out.where(F.lower("vtype") == vtype.lower())
    for c, ends in (("dim", dim), ("count", count)):
        if ends is not None:
            out = out.where(F.col(c).between(*ends))
    return out


def distinct_values(catalog: DataFrame) -> DataFrame:
    """(kind, value): every metric, vector type, facet and dimension there is."""
    parts = [catalog.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("metric", "metric"), ("vtype", "vtype"), ("dim", "dim"))]
    parts.append(catalog.select(F.lit("facet").alias("kind"), F.explode("facets").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def record_stats(records: DataFrame, payload: str, page_bytes: int = 65_536) -> DataFrame:
    """(records, bytes, min, max, mean, pages, utilisation): record sizes, and how full pages of a size would be that take records in order."""
    n = F.octet_length(payload)
    at = records.agg(F.count(F.lit(1)).alias("records"), F.sum(n).alias("bytes"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"))
    # A record takes its bytes and an offset of four; a page has 28 bytes of its own.
    pages = F.ceil((F.col("bytes") + 4 * F.col("records")) / (page_bytes - 28))
    return at.withColumn("pages", pages).withColumn("utilisation", F.col("bytes") / (F.col("pages") * page_bytes))


def dataset_json(catalog: DataFrame) -> DataFrame:
    """(dataset, json): one object per data set, of its profiles' facets and sources, from (dataset, profile, facet, source)."""
    facets = catalog.groupBy("dataset", "profile").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("facet", "source")))).alias("facets"))
    out = facets.groupBy("dataset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("profile", F.to_json("facets").alias("f"))))).alias("p"))
    text = F.array_join(F.transform(F.map_entries("p"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return out.select("dataset", F.concat(F.lit('{"profiles":{'), text, F.lit("}}")).alias("json"))


def variables_json(variables: DataFrame) -> DataFrame:
    """(dataset_name, json): each data set's variables as one object, in order of their names."""
    rows = variables.groupBy("dataset_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("v"))
    return rows.select("dataset_name", F.to_json("v").alias("json"))
