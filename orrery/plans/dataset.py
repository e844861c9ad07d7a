"""Data sets: facets of a vector benchmark, by profile, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.plans import notation
from orrery.sources import formats

#: Facets by letter, with their names. F is filtered before, E after the search.
FACETS = {
    "B": "base_vectors", "Q": "query_vectors", "G": "neighbor_indices", "D": "neighbor_distances", "M": "metadata_content",
    "P": "metadata_predicates", "R": "predicate_results", "F": "prefiltered_neighbors", "E": "postfiltered_neighbors", "O": "partitions",
}


def facet_name(key: str) -> str:
    """A facet by its letter or its name."""
    if key.upper() in FACETS and len(key) == 1:
        return FACETS[key.upper()]
    if key in FACETS.values():
        return key
    raise KeyError(f"unknown facet {key!r}")


@dataclass
class Dataset:
    """Facets of each profile as sources, ``path[window]``; a profile takes what it lacks from ``default``."""

    name: str
    profiles: dict[str, dict[str, str]]
    root: str = ""
    attributes: dict[str, str] = field(default_factory=dict)

    def source(self, facet: str, profile: str = "default") -> str:
        name = facet_name(facet)
        for p in (profile, "default"):
            if name in self.profiles.get(p, {}):
                return self.profiles[p][name]
        raise KeyError(f"{self.name} has no {name} in {profile}")

    def facet(self, spark: SparkSession, facet: str, profile: str = "default") -> DataFrame:
        """A facet's rows, its window as a filter on the ordinal."""
        path, _, window = notation.source(self.source(facet, profile))
        path = f"{self.root.rstrip('/')}/{path}" if self.root and "://" not in path and not path.startswith("/") else path
        kind = "parquet" if path.endswith(".parquet") else formats.probe(path)
        df = spark.read.format(kind).load(path)
        return df.where(notation.in_windows(F.col("ordinal"), window)) if window else df

    def sized(self, ladder: str, base: int) -> "Dataset":
        """With a profile for each size of a ladder: the first n base vectors."""
        more = {}
        for n in notation.strata(ladder, base):
            own = dict(self.profiles["default"])
            path, _, _ = notation.source(own["base_vectors"])
            own["base_vectors"] = f"{path}[0..{n})"
            more[notation.size_name(n)] = {"base_vectors": own["base_vectors"]}
        return Dataset(self.name, self.profiles | more, self.root, self.attributes)

    def derive(self, spark: SparkSession, profile: str, to: str) -> "Dataset":
        """A profile as a data set of its own: each facet written as Parquet, ordinals from 0."""
        facets = {}
        for f in sorted(self.profiles["default"] | self.profiles.get(profile, {})):
            rows = self.facet(spark, f, profile)
            low = rows.agg(F.min("ordinal")).first()[0] or 0
            rows.withColumn("ordinal", F.col("ordinal") - low).write.parquet(f"{to}/{f}.parquet")
            facets[f] = f"{f}.parquet"
        return Dataset(f"{self.name}-{profile}", {"default": facets}, to, self.attributes)

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(dataset, profile, facet, source): the catalog's rows of this data set."""
        return [(self.name, p, f, s) for p, fs in self.profiles.items() for f, s in fs.items()]


def catalog(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    return spark.createDataFrame([r for d in datasets for r in d.rows()], "dataset string, profile string, facet string, source string")
