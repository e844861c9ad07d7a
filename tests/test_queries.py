"""Every registered query of the reference's operators beside its SQL, on the small tables."""

import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

OWN = {k: f for m in entry.MODULES for k, f in importlib.import_module(f"orrery.queries.{m}").QUERIES.items()}
SQL = {k: s for m in entry.MODULES for k, s in importlib.import_module(f"orrery.queries.{m}").ORACLES.items()}
#: Neither needs SQL: seeded hashes, eigenvalues and trees folded level by level have tests of their own.
WITHOUT = {"shuffle_split", "survey_sample", "pca_eigen", "pca_summary", "merkle_summary", "generate_vectors", "generate_metadata"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_all_but_a_few_have_sql():
    assert set(OWN) - set(SQL) == WITHOUT and set(SQL) <= set(OWN)
    assert set(OWN) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf, con, name):
    df = OWN[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    if name in WITHOUT:
        assert mine
        return
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert mine == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10 * entry.entry(spark).select("query_id").distinct().count() > 0
