"""Column builders on vectors held as arrays. Sums run in DOUBLE, in component order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types of vector files and the Spark type that holds each.
ELEMENTS = {
    "f16": "float", "f32": "float", "f64": "double",
    "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)",
    "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint",
}
#: The metrics by any name that the command line takes.
METRICS = {"L2": "L2", "EUCLIDEAN": "L2", "COSINE": "COSINE", "DOT": "DOT", "DOT_PRODUCT": "DOT", "DOTPRODUCT": "DOT", "IP": "DOT", "L1": "L1", "MANHATTAN": "L1"}


def metric_name(metric: str) -> str:
    try:
        return METRICS[metric.upper()]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}") from None


def doubles(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; never its root."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalized(v: Column, to: str = "float") -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n)).cast(f"array<{to}>")


def distance(metric: str, a: Column, b: Column) -> tuple[Column, Column]:
    """(kernel, published): the kernel is smaller for nearer vectors; L2 is published squared, dot and cosine as similarities."""
    name = metric_name(metric)
    if name == "L2":
        d = l2sq(a, b)
        return d, d
    if name == "L1":
        d = l1(a, b)
        return d, d
    s = dot(a, b) if name == "DOT" else cosine(a, b)
    return (-s if name == "DOT" else 1 - s), s


def bits(v: Column) -> Column:
    """A string that is equal just for bitwise equal vectors of floats, so that -0.0 and 0.0 differ and equal NaNs match."""
    # The text of a double tells -0.0 from 0.0; there is one NaN in Spark.
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def converted(v: Column, to: str) -> Column:
    """Elements in another type; integers are rounded towards zero and held within the type's range."""
    kind = ELEMENTS[to]
    if to.startswith("f"):
        return v.cast(f"array<{kind}>")
    width = int(to[1:])
    low, high = (0, 2**width - 1) if to[0] == "u" else (-(2 ** (width - 1)), 2 ** (width - 1) - 1)
    whole = "decimal(20,0)" if width == 64 else "bigint"
    return F.transform(v, lambda x: F.greatest(F.least(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), F.lit(str(high)).cast(whole)), F.lit(str(low)).cast(whole)).cast(kind))
