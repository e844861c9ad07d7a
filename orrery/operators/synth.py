"""Synthesis: predicates of a wanted selectivity from what the survey says of a field, and vectors and records from seeds.

Every number is a hash of its ordinal, place and seed, so that rows do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import vec
from orrery.functions.predicate import Node, Pred
from orrery.operators.stats import quantiles


def uniform(*keys: Column) -> Column:
    """A double in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(F.lit(1), *keys))) * F.cos(2 * math.pi * uniform(F.lit(2), *keys))


def generate_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, kind: str = "normal", normalize: bool = False, zeros: int = 0, duplicates: int = 0, element: str = "f32") -> DataFrame:
    """(ordinal, vec): n vectors. The first ``zeros`` are zero, the last ``duplicates`` repeat those before them."""
    source = F.when(F.col("id") >= n - duplicates, F.col("id") - duplicates).otherwise(F.col("id"))
    draw = {"normal": lambda i: normal(source, i, F.lit(seed)), "uniform": lambda i: uniform(source, i, F.lit(seed))}[kind]
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(source < zeros, 0.0).otherwise(draw(i)))
    out = spark.range(n).select(F.col("id").alias("ordinal"), v.alias("vec"))
    if normalize:
        out = out.withColumn("vec", vec.normalized(F.col("vec"), "double"))
    return out.withColumn("vec", vec.converted(F.col("vec"), element))


def read_model(rows: list[dict]) -> list[dict]:
    """A fitted model's rows with one spelling of the parameters: mu or mean, sigma or std_dev."""
    return [{"kind": r["kind"], "mean": r.get("mean", r.get("mu")), "std_dev": r.get("std_dev", r.get("sigma")), "lower": r.get("lower"), "upper": r.get("upper"), "alpha": r.get("alpha"), "beta": r.get("beta")} for r in rows]


def _gamma(shape: float, i: int, seed: int, tries: int = 24) -> Column:
    """A gamma number of unit scale, by Marsaglia and Tsang: the first accepted of hashed proposals."""
    boost = shape < 1
    d = (shape + 1 if boost else shape) - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def proposal(k: Column) -> Column:
        x = normal(F.col("id"), F.lit(i), F.lit(seed), k)
        v = F.pow(1 + c * x, F.lit(3.0))
        u = uniform(F.col("id"), F.lit(i), F.lit(seed), k, F.lit(3))
        return F.when((v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v).otherwise(1.0))), d * v)

    found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), proposal), lambda x: x.isNotNull()), F.lit(0))
    out = F.coalesce(found, F.lit(d))
    return out * F.pow(uniform(F.col("id"), F.lit(i), F.lit(seed), F.lit(4)), F.lit(1 / shape)) if boost else out


def vectors_from_model(spark: SparkSession, model: list[dict], n: int, seed: int = 0) -> DataFrame:
    """(ordinal, vec): components drawn by each dimension's fitted normal, uniform or beta law."""
    cols = []
    for i, m in enumerate(read_model(model)):
        u = uniform(F.col("id"), F.lit(i), F.lit(seed))
        if m["kind"] == "uniform":
            cols.append(m["lower"] + (m["upper"] - m["lower"]) * u)
        elif m["kind"] == "beta":
            a, b = _gamma(m["alpha"], 2 * i, seed), _gamma(m["beta"], 2 * i + 1, seed)
            low, high = m["lower"] if m["lower"] is not None else 0.0, m["upper"] if m["upper"] is not None else 1.0
            cols.append(low + (high - low) * (a / (a + b)))
        else:
            cols.append(m["mean"] + m["std_dev"] * normal(F.col("id"), F.lit(i), F.lit(seed)))
    return spark.range(n).select(F.col("id").alias("ordinal"), F.array(*cols).cast("array<float>").alias("vec"))


def sketch_vectors(spark: SparkSession, n: int, dim: int, mix: str = "mixed", seed: int = 0) -> DataFrame:
    """Unit vectors whose dimensions follow one law or take turns: normal, uniform, beta, bounded, mixed."""
    laws = {
        "normal": {"kind": "normal", "mean": 0.0, "std_dev": 1.0},
        "uniform": {"kind": "uniform", "lower": -1.0, "upper": 1.0},
        "beta": {"kind": "beta", "alpha": 2.0, "beta": 5.0, "lower": -1.0, "upper": 1.0},
    }
    laws["bounded"] = laws["uniform"]
    turn = [laws[k] for k in ("normal", "uniform", "beta")] if mix == "mixed" else [laws[mix]]
    out = vectors_from_model(spark, [turn[i % len(turn)] for i in range(dim)], n, seed)
    return out.withColumn("vec", vec.normalized(F.col("vec")))


def generate_metadata(spark: SparkSession, n: int, fields: dict[str, tuple[int, int]], seed: int = 0) -> DataFrame:
    """(ordinal, fields): whole numbers, evenly over each field's closed range."""
    cols = [(F.lit(low) + F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(high - low + 1))).alias(name) for name, (low, high) in fields.items()]
    return spark.range(n).select(F.col("id").alias("ordinal"), *cols)


def simple_predicates(spark: SparkSession, n: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """(pred_id, value): equality values, evenly over a closed range."""
    return spark.range(n).select(F.col("id").cast("int").alias("pred_id"), (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1))).alias("value"))


def numeric_predicates(df: DataFrame, field: str, selectivity: float) -> list[Pred]:
    """Predicates on both ends that about this share of records meets, from exact quantiles: <= and >= for whole numbers, < and > otherwise."""
    low, high = quantiles(df.select(F.col(field).alias("x")), [selectivity, 1 - selectivity]).first()
    whole = isinstance(df.schema[field].dataType, T.IntegralType)
    return [Pred(field, "le" if whole else "lt", (low,)), Pred(field, "ge" if whole else "gt", (high,))]


def categorical_predicate(df: DataFrame, field: str, selectivity: float) -> Pred:
    """Equality with the value whose count is nearest the wanted share; of equals the least value."""
    n = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    best = n.crossJoin(F.broadcast(total)).orderBy(F.abs(F.col("n") - selectivity * F.col("t")), field).first()
    return Pred(field, "eq", (best[field],))


def boolean_predicate(df: DataFrame, field: str, selectivity: float) -> Pred:
    return categorical_predicate(df, field, selectivity)


def trigram_predicate(df: DataFrame, field: str, selectivity: float, k: int = 1024) -> Pred:
    """MATCHES with the frequent trigram that stands in the share of records nearest the wanted one."""
    found = F.array_distinct(F.regexp_extract_all(field, F.lit("(?s)(?=(...))"), F.lit(1)))
    n = df.select(F.explode(found).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(k)
    total = df.count()
    return Pred(field, "matches", (n.orderBy(F.abs(F.col("n") - selectivity * total), "g").first()["g"],))


def reservoir_predicate(df: DataFrame, field: str, key: str, seed: int = 0) -> Pred:
    """Equality with the value of the record whose seeded hash is least."""
    return Pred(field, "eq", (df.where(F.col(field).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).first()[field],))


def compound_predicates(df: DataFrame, n: int, selectivity: float, fields: list[str] | None = None, without: tuple[str, ...] = (), ops: tuple[str, ...] = ("lt", "le", "gt", "ge", "eq"), joined: int = 1, key: str | None = None, seed: int = 0, unique: float = 0.0) -> list[Pred | Node]:
    """n predicates of ``joined`` comparisons each, every one on its own field, together of about the selectivity if fields are independent.

    Fields are those given, or all numeric, text and Boolean ones, less ``without`` and ``key``; only the given
    operators are used. An error if fewer than the share ``unique`` of the predicates differ.
    """
    import random

    able = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    names = [f for f in (fields or able) if f not in without and f != key]
    rng, share, pool = random.Random(seed), selectivity ** (1 / joined), {}
    for f in names:
        own = numeric_predicates(df, f, share) if isinstance(df.schema[f].dataType, T.NumericType) and set(ops) & {"lt", "le", "gt", "ge"} else []
        if not own and "eq" in ops:
            own = [categorical_predicate(df, f, share)]
        if own := [p for p in own if p.op in ops and p.values[0] is not None]:
            pool[f] = own
    if len(pool) < joined:
        raise ValueError(f"{len(pool)} fields have a predicate, {joined} are needed")
    out = []
    for _ in range(n):
        parts = [rng.choice(pool[f]) for f in rng.sample(sorted(pool), joined)]
        out.append(parts[0] if joined == 1 else Node("and", tuple(parts)))
    if len(set(out)) < unique * n:
        raise ValueError(f"only {len(set(out))} of {n} predicates differ")
    return out


def from_template(template: str, df: DataFrame, selectivity: float) -> Pred | Node:
    """A predicate from its text form with values left as ``?``: each is filled so that its comparison has the selectivity."""
    from orrery.functions.predicate import OPS, parse

    shape = parse(template.replace("?", "'?'"))

    def fill(p: Pred | Node) -> Pred | Node:
        if isinstance(p, Node):
            return Node(p.kind, tuple(map(fill, p.children)))
        if p.values != ("?",):
            return p
        f = str(p.field)
        if p.op in ("lt", "le", "gt", "ge"):
            low, high = numeric_predicates(df, f, selectivity)
            return Pred(f, p.op, (low if p.op in ("lt", "le") else high).values)
        if p.op == "matches":
            return trigram_predicate(df, f, selectivity)
        value = categorical_predicate(df, f, selectivity if p.op != "ne" else 1 - selectivity).values
        return Pred(f, p.op, value) if p.op in OPS else p

    return fill(shape)
