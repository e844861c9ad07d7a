"""Selection, clean-up and statistics over ``embeddings``, with zeros and duplicates put in the same way here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import extract, hygiene, stats
from orrery.session import table


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector zero, every 25th but one again under another id."""
    e = emb(spark, sf).select("vec_id", "embedding")
    zeroed = e.withColumn("embedding", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: F.abs(x * 0).cast("float"))).otherwise(F.col("embedding")))
    return zeroed.unionByName(e.where("vec_id % 25 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000))


def exploded(df: DataFrame, *keep: str, vec_col: str = "embedding") -> DataFrame:
    """One row per component, as SQL compares them."""
    return df.select(*keep, F.posexplode(vec_col).alias("dim", "x"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded; without names, all of them."""
    names = cols or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def _index(spark: SparkSession) -> DataFrame:
    return spark.range(60).select(F.col("id").alias("pos"), (F.col("id") * 37 % 101).alias("ordinal"))


def _extract_index(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(extract.extract_by_index(emb(spark, sf), _index(spark), (10, 40)), "pos", "vec_id")


def _extract_predicate(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    results = e.select(F.col("label").alias("pred_id"), F.col("vec_id").alias("ordinal"))
    return extract.extract_by_predicate(e, results, 3).select("vec_id", "label")


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    d = dirty(spark, sf)
    order = hygiene.sort_vectors(d)
    dups = hygiene.dedup_vectors(d).where("duplicate")
    return extract.clean_ordinals(order, dups, hygiene.find_zeros(d)).select("pos", "ordinal")


def _find(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    probe = [float(x) for x in e.where("vec_id = 42").first()["embedding"]]
    return extract.find_vector(e, probe, 5)


def _converted(vectors: DataFrame) -> DataFrame:
    return exploded(extract.convert_elements(vectors, "i8", scale=127.0), "vec_id")


def _normalized(vectors: DataFrame) -> DataFrame:
    tripled = vectors.withColumn("embedding", F.transform("embedding", lambda x: (x * 3).cast("float")))
    return exploded(hygiene.normalize_vectors(tripled), "vec_id").withColumn("x", F.round(F.col("x").cast("double"), 5))


def _shared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every 20th vector, and all others with a copy of every 100th under another id: a fifth of the queries are in the base, whatever the size."""
    e = emb(spark, sf).select("vec_id", "embedding")
    copies = e.where("vec_id % 100 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0").unionByName(copies)


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = emb(spark, sf)
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


def _model_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.model_diff(*map(stats.fit_model, _halves(spark, sf))))


def _ks_model(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    return rounded(stats.ks_model(e, stats.fit_model(e)), digits=5)


QUERIES = {
    "convert_elements": lambda s, sf: _converted(emb(s, sf)),
    "select_ordinals": lambda s, sf: extract.select_ordinals(emb(s, sf), "3,7,10..19,[20,25),(30,33]").select("vec_id", "label"),
    "slice_vectors": lambda s, sf: exploded(extract.slice_vectors(emb(s, sf), 10, 30, 4, 5), "vec_id"),
    "extract_by_index": _extract_index,
    "extract_by_range": lambda s, sf: extract.extract_by_range(emb(s, sf), 480, 10_000).select("vec_id", "pos"),
    "extract_by_predicate": _extract_predicate,
    "clean_ordinals": _clean,
    "find_vector": _find,
    "describe_vectors": lambda s, sf: extract.describe_vectors(emb(s, sf)),
    "sort_vectors": lambda s, sf: hygiene.sort_vectors(dirty(s, sf)),
    "dedup_vectors": lambda s, sf: hygiene.dedup_vectors(dirty(s, sf)),
    "dedup_report": lambda s, sf: hygiene.dedup_report(dirty(s, sf)),
    "find_duplicates": lambda s, sf: hygiene.find_duplicates(dirty(s, sf)),
    "find_zeros": lambda s, sf: hygiene.find_zeros(dirty(s, sf)),
    "zeros_summary": lambda s, sf: hygiene.zeros_summary(dirty(s, sf)),
    "measure_normals": lambda s, sf: rounded(hygiene.measure_normals(emb(s, sf)), digits=9),
    "check_normalization": lambda s, sf: hygiene.check_normalization(dirty(s, sf)),
    "fvecs_check": lambda s, sf: hygiene.fvecs_check(dirty(s, sf)),
    "normalize_vectors": lambda s, sf: _normalized(emb(s, sf)),
    "remove_zeros": lambda s, sf: hygiene.remove_zeros(dirty(s, sf)).select("vec_id"),
    "overlap": lambda s, sf: rounded(hygiene.overlap(*_shared(s, sf))),
    "remove_overlap": lambda s, sf: hygiene.remove_overlap(*_shared(s, sf)).select("vec_id"),
    "shuffle_split": lambda s, sf: hygiene.shuffle_split(emb(s, sf), 50, seed=42),
    "stats_global": lambda s, sf: rounded(stats.stats_global(emb(s, sf))),
    "stats_per_dimension": lambda s, sf: rounded(stats.stats_per_dimension(emb(s, sf))),
    "stats_dimension_detail": lambda s, sf: rounded(stats.stats_dimension_detail(emb(s, sf), 5)),
    "dimension_histogram": lambda s, sf: rounded(stats.dimension_histogram(emb(s, sf), 5)),
    "norms_distribution": lambda s, sf: rounded(stats.norms_distribution(emb(s, sf))),
    "ks_compare": lambda s, sf: rounded(stats.ks_compare(*_halves(s, sf))),
    "ks_model": _ks_model,
    "fit_model": lambda s, sf: rounded(stats.fit_model(emb(s, sf), low=-1.0, high=1.0)),
    "model_diff": _model_diff,
    "pairwise_distances": lambda s, sf: rounded(stats.pairwise_distances(emb(s, sf), 10)),
    "pairwise_contrast": lambda s, sf: rounded(stats.contrast(stats.pairwise_distances(emb(s, sf), 10))),
    "pca_eigen": lambda s, sf: rounded(stats.eigen_frame(emb(s, sf))),
    "pca_summary": lambda s, sf: rounded(stats.pca_summary(stats.eigen_frame(emb(s, sf)))),
    "covariance": lambda s, sf: rounded(stats.covariance(emb(s, sf)), digits=9),
}

_DIRTY = """d AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: abs(x * 0)::FLOAT) ELSE embedding END AS v FROM embeddings
UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 25 = 1)"""
_NORM = "sqrt(list_sum(list_transform({}, lambda x: x::DOUBLE * x::DOUBLE)))"
_C = "c AS (SELECT i - 1 AS dim, embedding[i]::DOUBLE AS x, vec_id FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_MOMENTS = """count(*) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS std_dev,
round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / var_pop(x) ** 1.5, 6) AS skewness, round(kurtosis_pop(x) + 3, 6) AS kurtosis"""
_FIT = "SELECT dim, 'normal' AS kind, avg(x) AS mean, stddev_pop(x) AS std_dev, min(x) AS lower, max(x) AS upper FROM c"
_ERF = "(CASE WHEN z < 0 THEN -1 ELSE 1 END) * (1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z))"
_SHARED = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT embedding FROM embeddings WHERE vec_id % 20 <> 0 UNION ALL SELECT embedding FROM embeddings WHERE vec_id % 100 = 0)"""

ORACLES = {
    "convert_elements": "SELECT vec_id, (i - 1)::INT AS dim, trunc(greatest(least(embedding[i]::DOUBLE * 127.0, 127), -128))::TINYINT AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
    "select_ordinals": "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 7, 31, 32, 33) OR vec_id BETWEEN 10 AND 24",
    "slice_vectors": "SELECT vec_id, (i - 1)::INT AS dim, embedding[i + 4] AS x FROM (SELECT vec_id, embedding, unnest(range(1, 6)) AS i FROM embeddings WHERE vec_id BETWEEN 10 AND 30)",
    "extract_by_index": "WITH p AS (SELECT p - 10 AS pos, p * 37 % 101 AS ordinal FROM range(10, 40) AS r(p)) SELECT pos, vec_id, (i - 1)::INT AS dim, embedding[i] AS x FROM (SELECT pos, vec_id, embedding, unnest(range(1, 65)) AS i FROM p JOIN embeddings ON vec_id = ordinal)",
    "extract_by_range": "SELECT vec_id, vec_id - 480 AS pos FROM embeddings WHERE vec_id >= 480 AND vec_id < 10000",
    "extract_by_predicate": "SELECT vec_id, label FROM embeddings WHERE label = 3",
    "clean_ordinals": f"""WITH {_DIRTY}, k AS (SELECT vec_id, v, row_number() OVER (PARTITION BY v ORDER BY vec_id) AS copy FROM d)
SELECT row_number() OVER (ORDER BY v, vec_id) - 1 AS pos, vec_id AS ordinal FROM k WHERE copy = 1 AND {_NORM.format('v')} >= 1e-6""",
    "find_vector": """WITH p AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 42), m AS (SELECT vec_id, len(list_filter(list_zip(embedding, e), lambda z: z[1] = z[2]))::INT AS matching, embedding = e AS exact FROM embeddings, p)
SELECT * FROM m ORDER BY exact DESC, matching DESC, vec_id LIMIT 5""",
    "describe_vectors": "SELECT 'float' AS element, count(*) AS count, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, 0::BIGINT AS nulls FROM embeddings",
    "sort_vectors": f"WITH {_DIRTY} SELECT row_number() OVER (ORDER BY v, vec_id) - 1 AS pos, vec_id AS ordinal FROM d",
    "dedup_vectors": f"WITH {_DIRTY} SELECT vec_id AS ordinal, min(vec_id) OVER (PARTITION BY v) AS first, vec_id <> min(vec_id) OVER (PARTITION BY v) AS duplicate FROM d",
    "dedup_report": f"""WITH {_DIRTY}, g AS (SELECT v, count(*) AS n, {_NORM.format('v')} = 0 AS z FROM d GROUP BY v)
SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (z), 0)::BIGINT AS zeros, sum(n - 1) FILTER (NOT z)::BIGINT AS duplicates, count(*) FILTER (NOT z) AS "unique" FROM g""",
    "find_duplicates": f"WITH {_DIRTY}, g AS (SELECT count(*) AS group_size FROM d GROUP BY v) SELECT group_size, count(*) AS groups FROM g GROUP BY 1",
    "find_zeros": f"WITH {_DIRTY} SELECT vec_id AS ordinal FROM d WHERE {_NORM.format('v')} < 1e-6",
    "zeros_summary": f"WITH {_DIRTY} SELECT count(*) AS total, count(*) FILTER ({_NORM.format('v')} = 0) AS exact_zeros, count(*) FILTER ({_NORM.format('v')} < 1e-6) AS near_zeros FROM d",
    "measure_normals": f"""WITH e AS (SELECT abs({_NORM.format('embedding')} - 1) AS e, len(embedding) AS dim FROM embeddings)
SELECT count(*) AS count, round(avg(e), 9) AS mean, round(min(e), 9) AS min, round(max(e), 9) AS max, round(stddev_pop(e), 9) AS stddev, round(median(e), 9) AS median, max(dim)::INT AS dim, avg(e) < 10 * pow(2, -23) * sqrt(max(dim)) AS is_normalized FROM e""",
    "check_normalization": f"WITH {_DIRTY} SELECT count(*) AS total, count(*) FILTER ({_NORM.format('v')} = 0) AS zeros, bool_and(abs({_NORM.format('v')} - 1) < 1e-3) AS normalized FROM d",
    "fvecs_check": f"WITH {_DIRTY}, e AS (SELECT abs({_NORM.format('v')} - 1) AS e FROM d) SELECT CASE WHEN e < 1e-12 THEN -99 ELSE floor(log10(e)) END::INT AS magnitude, count(*) AS n, count(*) FILTER (e < 1e-5) AS within FROM e GROUP BY 1",
    "normalize_vectors": f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT) AS v FROM embeddings), n AS (SELECT *, {_NORM.format('v')} AS n FROM t)
SELECT vec_id, (i - 1)::INT AS dim, round((v[i]::DOUBLE / n)::FLOAT::DOUBLE, 5) + 0.0 AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM n)""",
    "remove_zeros": f"WITH {_DIRTY} SELECT vec_id FROM d WHERE {_NORM.format('v')} >= 1e-6",
    "overlap": f"{_SHARED} SELECT count(*) AS queries, count(*) FILTER (s) AS shared, round(count(*) FILTER (s) / count(*), 6) AS fraction FROM (SELECT embedding IN (SELECT embedding FROM b) AS s FROM q)",
    "remove_overlap": f"{_SHARED} SELECT vec_id FROM q WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.embedding = q.embedding)",
    "stats_global": f"WITH {_C} SELECT {_MOMENTS} FROM c",
    "stats_per_dimension": f"WITH {_C} SELECT dim::INT AS dim, {_MOMENTS} FROM c GROUP BY dim",
    "stats_dimension_detail": f"""WITH {_C}, x AS (SELECT x FROM c WHERE dim = 5), q AS (SELECT {', '.join(f'quantile_cont(x, {p / 100}) AS p{p}' for p in stats.PERCENTS)} FROM x)
SELECT {', '.join(f'round(p{p}, 6) AS p{p}' for p in stats.PERCENTS)}, round(p75 - p25, 6) AS iqr, round(p25 - 1.5 * (p75 - p25), 6) AS lower_fence, round(p75 + 1.5 * (p75 - p25), 6) AS upper_fence,
count(*) FILTER (x < p25 - 1.5 * (p75 - p25)) AS low_outliers, count(*) FILTER (x > p75 + 1.5 * (p75 - p25)) AS high_outliers FROM x, q GROUP BY ALL""",
    "dimension_histogram": f"""WITH {_C}, x AS (SELECT x FROM c WHERE dim = 5), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM x), h AS (SELECT least(floor((x - lo) / w), 19)::INT AS bin, lo, w FROM x, e)
SELECT bin, round(lo + bin * w, 6) AS low, count(*) AS n FROM h GROUP BY bin, lo, w""",
    "norms_distribution": f"""WITH x AS (SELECT {_NORM.format('embedding')} AS x FROM embeddings)
SELECT {', '.join(f"round(quantile_cont(x, {p / 100}), 6) AS p{str(p).replace('.', '_')}" for p in (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9, 100))}, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_dev, count(*) FILTER (x = 0) AS zeros, count(*) AS count FROM x""",
    "ks_compare": f"""WITH {_C}, n AS (SELECT dim, x, count(*) FILTER (vec_id % 2 = 0) AS a, count(*) FILTER (vec_id % 2 = 1) AS b FROM c GROUP BY dim, x),
r AS (SELECT dim, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY dim) AS na, sum(b) OVER (PARTITION BY dim) AS nb FROM n WINDOW w AS (PARTITION BY dim ORDER BY x)),
d AS (SELECT dim, max(abs(ca / na - cb / nb)) AS d, max(na) AS na, max(nb) AS nb FROM r GROUP BY dim),
l AS (SELECT dim, d, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * d AS lam FROM d)
SELECT dim::INT AS dim, round(d, 6) AS d, round(CASE WHEN lam < 1e-3 THEN 1 ELSE greatest(least(list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2 * j * j * lam * lam))), 1), 0) END, 6) AS p FROM l""",
    "ks_model": f"""WITH {_C}, m AS ({_FIT} GROUP BY dim), v AS (SELECT dim, x, count(*) AS k FROM c GROUP BY dim, x),
z AS (SELECT v.dim, v.x, k, (v.x - mean) / (std_dev * sqrt(2)) AS z, 1 / (1 + 0.3275911 * abs((v.x - mean) / (std_dev * sqrt(2)))) AS t FROM v JOIN m USING (dim)),
f AS (SELECT dim, 0.5 * (1 + {_ERF}) AS f, k, sum(k) OVER (PARTITION BY dim ORDER BY x) AS c, sum(k) OVER (PARTITION BY dim) AS n FROM z)
SELECT dim::INT AS dim, round(max(greatest(abs(c / n - f), abs((c - k) / n - f))), 5) AS d FROM f GROUP BY dim""",
    "fit_model": f"""WITH {_C}, m AS ({_FIT} GROUP BY dim), b AS (SELECT *, (mean + 1) / 2 AS u, (std_dev / 2) ** 2 AS v FROM m), k AS (SELECT *, u * (1 - u) / v - 1 AS common FROM b)
SELECT dim::INT AS dim, 'beta' AS kind, round(mean, 6) AS mean, round(std_dev, 6) AS std_dev, round(lower, 6) AS lower, round(upper, 6) AS upper, round(u * common, 6) AS alpha, round((1 - u) * common, 6) AS beta FROM k""",
    "model_diff": f"""WITH {_C}, a AS ({_FIT} WHERE vec_id % 2 = 0 GROUP BY dim), b AS ({_FIT} WHERE vec_id % 2 = 1 GROUP BY dim)
SELECT a.dim::INT AS dim, true AS same_kind, round(abs(a.mean - b.mean) / greatest(abs(a.mean), abs(b.mean)) * 100, 6) AS mean_drift, round(abs(a.std_dev - b.std_dev) / greatest(a.std_dev, b.std_dev) * 100, 6) AS std_drift FROM a JOIN b USING (dim)""",
    "pairwise_distances": """WITH h AS (SELECT unnest([1, 7, 31]) AS hop) SELECT l.vec_id AS a, r.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS distance
FROM embeddings l, h, embeddings r WHERE l.vec_id % 10 = 0 AND r.vec_id = l.vec_id + hop""",
    "pairwise_contrast": """WITH h AS (SELECT unnest([1, 7, 31]) AS hop), p AS (SELECT sqrt(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d
FROM embeddings l, h, embeddings r WHERE l.vec_id % 10 = 0 AND r.vec_id = l.vec_id + hop)
SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std_dev, round((max(d) - min(d)) / min(d), 6) AS contrast, round(stddev_pop(d) / avg(d), 6) AS cv FROM p""",
    "covariance": f"WITH {_C} SELECT a.dim::INT AS i, b.dim::INT AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL",
}
