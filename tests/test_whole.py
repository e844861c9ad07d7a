"""Queries over the whole table: what they cover grows with it."""

import pytest

import __spark_entry__ as entry
from orrery.session import table


@pytest.mark.parametrize("name", ["convert_elements", "normalize_vectors"])
def test_every_component_of_every_vector(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() == 64 * table(spark, sf, "embeddings").count()


@pytest.mark.parametrize("name", ["knn_l2", "knn_dot", "knn_cosine", "knn_l1", "partitioned_knn", "sized_profile_knn", "prefiltered_knn", "knn_ties", "knn_compare"])
def test_every_twentieth_row_is_a_query(spark, sf, name):
    e = table(spark, sf, "embeddings")
    got = entry.queries()[name](spark, sf)
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == {r.vec_id for r in e.where("vec_id % 20 = 0").collect()}
    if name == "sized_profile_knn":
        assert got.agg({"size": "max"}).first()[0] == e.count()
    if name == "knn_l2":
        assert got.where("rank = 0 AND query_id = neighbor_id").count() == e.where("vec_id % 20 = 0").count()


def test_overlap_grows_with_the_table(spark, sf):
    n = table(spark, sf, "embeddings").where("vec_id % 20 = 0").count()
    shared = entry.queries()["overlap"](spark, sf).first()
    assert shared.queries == n and shared.shared >= n // 5
    assert entry.queries()["remove_overlap"](spark, sf).count() == n - shared.shared
