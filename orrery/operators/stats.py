"""Vector statistics: moments, percentiles, histograms, tests of distributions, fitted models, pairwise distances, principal axes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.extract import running_sums
from orrery.session import cut, map_arrow

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def components(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dim, x): every component in DOUBLE."""
    return df.select(F.posexplode(vec.doubles(vec_col)).alias("dim", "x"))


def moments(x: str = "x") -> list[Column]:
    """count, min, max, mean, population variance and deviation, skewness, raw kurtosis (3 for a normal)."""
    return [
        F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("std_dev"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"),
    ]


def stats_global(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return components(df, vec_col).agg(*moments())


def stats_per_dimension(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return components(df, vec_col).groupBy("dim").agg(*moments())


def _ranked(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, k, upto) of the distinct values of a column ``x``: how often each comes, and how many values there are up to it; and their number, (total).

    Values are counted and put in order by ranges: no task holds more than a range of them.
    """
    counts = x.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    ranked = cut(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranked")
    sizes = ranked.groupBy("part").agg(F.sum("k").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))  # a row per task
    run = F.sum("k").over(Window.partitionBy("part").orderBy("x"))
    at = ranked.join(F.broadcast(offsets), "part").select("x", "k", (F.col("before") + run).alias("upto"))
    return at, sizes.agg(F.sum("n").alias("total"))


def percentiles(x: DataFrame, ps: list[float]) -> DataFrame:
    """One row, p0 and on: exact percentiles (0 to 100) of a column ``x`` by linear interpolation.

    Only the two values around each percentile leave the tasks. The built-in function would gather every
    distinct value in one.
    """
    at, n = _ranked(x)
    at = at.crossJoin(F.broadcast(n))

    def place(p: float, up: bool) -> Column:
        where = F.lit(p / 100) * (F.col("total") - 1)
        i = F.ceil(where) if up else F.floor(where)
        return F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("k") <= i), F.col("x")))

    ends = at.agg(F.max("total").alias("total"), *[place(p, up).alias(f"{'b' if up else 'a'}{i}") for i, p in enumerate(ps) for up in (False, True)])
    share = [F.lit(p / 100) * (F.col("total") - 1) - F.floor(F.lit(p / 100) * (F.col("total") - 1)) for p in ps]
    return ends.select(*[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * s).alias(f"p{i}") for i, s in enumerate(share)])


def quantiles(x: DataFrame, ps: list[float]) -> DataFrame:
    """One row, q0 and on: of a column ``x`` of any type in an order, the first value that at least the share p (0 to 1) of all does not exceed."""
    at, n = _ranked(x)
    need = [F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)) for p in ps]
    return at.crossJoin(F.broadcast(n)).agg(*[F.min(F.when(F.col("upto") >= w, F.col("x"))).alias(f"q{i}") for i, w in enumerate(need)])


def stats_dimension_detail(df: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Percentiles by linear interpolation, quartile range, fences at 1.5 ranges, and the number of values beyond them."""
    x = df.select(F.get(vec.doubles(vec_col), F.lit(dim)).alias("x"))
    q = percentiles(x, list(PERCENTS)).toDF(*[f"p{p}" for p in PERCENTS])
    q = q.withColumn("iqr", F.col("p75") - F.col("p25"))
    q = q.withColumns({"lower_fence": F.col("p25") - 1.5 * F.col("iqr"), "upper_fence": F.col("p75") + 1.5 * F.col("iqr")})
    out = x.crossJoin(F.broadcast(q)).groupBy(*q.columns)
    return out.agg(F.count_if(F.col("x") < F.col("lower_fence")).alias("low_outliers"), F.count_if(F.col("x") > F.col("upper_fence")).alias("high_outliers"))


def histogram(x: DataFrame, bins: int) -> DataFrame:
    """(bin, low, n) of a column ``x``: equal widths from the least to the greatest value, the last bin closed; one bin if all are equal."""
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    rows = x.where("x IS NOT NULL").crossJoin(F.broadcast(ends)).select(at.alias("bin"), "lo", width.alias("w"))
    return rows.groupBy("bin", "lo", "w").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), "n")


def dimension_histogram(df: DataFrame, dim: int, bins: int = 20, vec_col: str = "embedding") -> DataFrame:
    return histogram(df.select(F.get(vec.doubles(vec_col), F.lit(dim)).alias("x")), bins)


def norms_distribution(df: DataFrame, stride: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(p0 .. p100, mean, std_dev, zeros, count) of norms, of every ``stride``-th ordinal if asked for."""
    rows = df if stride == 1 else df.where(F.col(id_col) % stride == 0)
    x = rows.select(vec.norm(F.col(vec_col)).alias("x"))
    ps = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9, 100)
    named = percentiles(x, list(ps)).toDF(*[f"p{str(p).replace('.', '_')}" for p in ps])
    return named.crossJoin(_norm_sums(x))


def _norm_sums(x: DataFrame) -> DataFrame:
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"), F.count_if(F.col("x") == 0).alias("zeros"), F.count("x").alias("count"))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p of the two-sample statistic, by a hundred terms."""
    root = F.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * j * j * lam * lam))
    return F.when(lam < 1e-3, 1.0).otherwise(F.greatest(F.least(vec.total(terms), F.lit(1.0)), F.lit(0.0)))


def ks_compare(a: DataFrame, b: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dim, d, p): per dimension the largest distance of the two empirical distributions, exact where values tie.

    Running counts are kept by ranges of values, so that a dimension is as many tasks as it needs.
    """
    both = components(a, vec_col).select("dim", "x", F.lit(1).alias("a"), F.lit(0).alias("b")).union(components(b, vec_col).select("dim", "x", F.lit(0), F.lit(1)))
    at = both.groupBy("dim", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_sums(at, ["dim"], ["x"], ca=F.col("a"), cb=F.col("b"))
    n = at.groupBy("dim").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # a row per dimension
    out = run.join(F.broadcast(n), "dim").groupBy("dim").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return out.select("dim", "d", ks_p(F.col("d"), F.col("na"), F.col("nb")).alias("p"))


def _erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.when(x >= mean, 1.0).otherwise(0.0)).otherwise(0.5 * (1 + _erf((x - mean) / (std * math.sqrt(2)))))


def uniform_cdf(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.when(x >= low, 1.0).otherwise(0.0)).otherwise(F.greatest(F.least((x - low) / (high - low), F.lit(1.0)), F.lit(0.0)))


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h / a


def fit_model(df: DataFrame, vec_col: str = "embedding", low: float | None = None, high: float | None = None) -> DataFrame:
    """(dim, kind, mean, std_dev, lower, upper, alpha, beta): uniform if the range is under 1e-10; beta by moments if the data lie inside given bounds; else normal."""
    at = components(df, vec_col).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"), F.min("x").alias("lower"), F.max("x").alias("upper"))
    flat = (F.col("upper") - F.col("lower")) < 1e-10
    if low is None or high is None:
        none = F.lit(None).cast("double")
        return at.select("dim", F.when(flat, "uniform").otherwise("normal").alias("kind"), "mean", "std_dev", "lower", "upper", none.alias("alpha"), none.alias("beta"))
    m, v = (F.col("mean") - low) / (high - low), (F.col("std_dev") / (high - low)) ** 2
    common = m * (1 - m) / v - 1
    inside = ~flat & (F.col("lower") >= low) & (F.col("upper") <= high) & (v > 0) & (common > 0)
    kind = F.when(flat, "uniform").when(inside, "beta").otherwise("normal")
    return at.select("dim", kind.alias("kind"), "mean", "std_dev", "lower", "upper", F.when(inside, m * common).alias("alpha"), F.when(inside, (1 - m) * common).alias("beta"))


def model_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dim, same_kind, mean_drift, std_drift): drift in percent of the larger magnitude."""

    def drift(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        top = F.greatest(F.abs(x), F.abs(y))
        return F.when(top == 0, 0.0).otherwise(F.abs(x - y) / top * 100)

    both = a.alias("a").join(b.alias("b"), F.col("a.dim") == F.col("b.dim"), "full")
    return both.select(F.coalesce("a.dim", "b.dim").alias("dim"), F.col("a.kind").eqNullSafe(F.col("b.kind")).alias("same_kind"), drift("mean").alias("mean_drift"), drift("std_dev").alias("std_drift"))


def beta_cdfs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """beta_cdf() of arrays, equal parameters and values once."""
    keys, back = np.unique(np.stack([a, b, x], axis=1), axis=0, return_inverse=True)
    return np.array([beta_cdf(*k) for k in keys.tolist()])[back.reshape(-1)] if len(keys) else np.zeros(0)


def ks_model(df: DataFrame, model: DataFrame, vec_col: str = "embedding", low: float | None = None, high: float | None = None) -> DataFrame:
    """(dim, d): per dimension the distance of the data's distribution from a fitted normal, uniform or beta one.

    Beta models need the bounds ``low`` and ``high`` that they were fitted with.
    """
    # A model has a row per dimension: a few thousand at most.
    fitted = F.broadcast(model.select("dim", "kind", "mean", "std_dev", "lower", "upper", "alpha", "beta"))
    at = components(df, vec_col).groupBy("dim", "x").agg(F.count(F.lit(1)).alias("k")).join(fitted, "dim")
    beta = F.lit(None).cast("double")
    if not model.where("kind = 'beta'").isEmpty():
        if low is None or high is None:
            raise ValueError("a beta model needs the bounds that it was fitted with")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                col = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("x", "alpha", "beta")}
                own = np.array([k == "beta" for k in t.column("kind").to_pylist()], bool)
                f = np.full(t.num_rows, np.nan)
                f[own] = beta_cdfs(col["alpha"][own].astype(float), col["beta"][own].astype(float), (col["x"][own] - low) / (high - low))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(f)], names=[*t.schema.names, "f"])

        at = map_arrow(at, run, ", ".join(f"{n} {t}" for n, t in [*at.dtypes, ("f", "double")]))
        beta = F.col("f")
    cdf = F.when(F.col("kind") == "uniform", uniform_cdf(F.col("x"), F.col("lower"), F.col("upper"))).when(F.col("kind") == "beta", beta).otherwise(normal_cdf(F.col("x"), F.col("mean"), F.col("std_dev")))
    at = at.select("dim", "x", "k", cdf.alias("f"))
    n = at.groupBy("dim").agg(F.sum("k").alias("n"))
    at = running_sums(at, ["dim"], ["x"], c=F.col("k")).join(F.broadcast(n), "dim")
    up, down = F.abs(F.col("c") / F.col("n") - F.col("f")), F.abs((F.col("c") - F.col("k")) / F.col("n") - F.col("f"))
    return at.groupBy("dim").agg(F.max(F.greatest(up, down)).alias("d"))


def pairwise_distances(df: DataFrame, step: int, id_col: str = "vec_id", vec_col: str = "embedding", hops: tuple[int, ...] = (1, 7, 31)) -> DataFrame:
    """(a, b, distance): Euclidean distances, with the root, of pairs of ordinals.

    Every ``step``-th ordinal is paired with the ordinals some hops away: an equi-join, whose number
    of pairs grows with the sample and not with its square.
    """
    left = df.where(F.col(id_col) % step == 0).select(F.col(id_col).alias("a"), F.col(vec_col).alias("va"), F.explode(F.array(*map(F.lit, hops))).alias("hop"))
    left = left.withColumn("b", F.col("a") + F.col("hop"))
    right = df.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb"))
    return left.join(right, "b").select("a", "b", F.sqrt(vec.l2sq(F.col("va"), F.col("vb"))).alias("distance"))


def contrast(pairs: DataFrame) -> DataFrame:
    """(mean, std_dev, contrast, cv): contrast is (max - min) / min."""
    at = pairs.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std_dev"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    return at.select("mean", "std_dev", F.when(F.col("lo") > 0, (F.col("hi") - F.col("lo")) / F.col("lo")).alias("contrast"), F.when(F.col("mean") > 0, F.col("std_dev") / F.col("mean")).alias("cv"))


def covariance(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(i, j, cov): population covariance of component pairs, i no larger than j.

    Each task multiplies its centred vectors to one matrix, a row of which is a row of its output.
    """
    means = {r["dim"]: r["m"] for r in components(df, vec_col).groupBy("dim").agg(F.avg("x").alias("m")).collect()}  # a row per dimension
    centre = np.array([means[i] for i in range(len(means))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((len(centre), len(centre)))
        for b in batches:
            col = b.column(0).drop_null()
            if len(col):
                m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) - centre
                n, gram = n + len(m), gram + m.T @ m
        for i in range(len(centre) if n else 0):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([gram[i, i:]], pa.list_(pa.float64()))], names=["i", "n", "sums"])

    rows = map_arrow(df.select(vec.doubles(vec_col).alias("v")), run, "i int, n bigint, sums array<double>")
    cells = rows.select("i", "n", F.posexplode("sums").alias("j", "x"))
    return cells.groupBy("i", (F.col("i") + F.col("j")).alias("j")).agg((F.sum("x") / F.sum("n")).alias("cov"))


def pca_eigen(df: DataFrame, vec_col: str = "embedding") -> tuple[list[float], list[list[float]]]:
    """Eigenvalues in falling order and their vectors; the driver holds a dim-by-dim matrix alone."""
    rows = covariance(df, vec_col).toArrow()
    i, j, cov = (rows[c].to_numpy() for c in ("i", "j", "cov"))
    n = 1 + int(j.max(initial=-1))
    c = np.zeros((n, n))
    c[i, j] = c[j, i] = cov
    values, vectors = np.linalg.eigh(c)
    return np.maximum(values[::-1], 0).tolist(), vectors.T[::-1].tolist()


def eigen_frame(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(component, eigenvalue, share)."""
    values, _ = pca_eigen(df, vec_col)
    total = sum(values) or 1.0
    return df.sparkSession.createDataFrame([(i, v, v / total) for i, v in enumerate(values)], "component int, eigenvalue double, share double")


def pca_summary(eigen: DataFrame) -> DataFrame:
    """(effective_rank, intrinsic_dim, elbow_95): exp of the entropy of shares; eigenvalues over a hundredth of the first; components for 95 % of the variance."""
    # As many rows as dimensions.
    w = Window.orderBy("component")
    at = eigen.withColumns({"cum": F.sum("share").over(w), "top": F.max("eigenvalue").over(Window.partitionBy(F.lit(1)))})
    entropy = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0))
    return at.agg(F.exp(entropy).alias("effective_rank"), F.count_if(F.col("eigenvalue") > F.col("top") / 100).alias("intrinsic_dim"), (F.count_if(F.col("cum") < 0.95) + 1).alias("elbow_95"))


def pca_project(df: DataFrame, vectors: list[list[float]], mean: list[float], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, projection): centred vectors on the given axes."""
    centred = F.zip_with(vec.doubles(vec_col), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return df.select(id_col, F.array(*[vec.dot(centred, F.array(*map(F.lit, axis))) for axis in vectors]).alias("projection"))
