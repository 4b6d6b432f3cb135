"""Each query against its DuckDB twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from growmap.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), str(round(v, 4)) if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    rel = db.sql(registry.SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_empty_neurons_of_all_rows(spark):
    from growmap.plans import queries

    empty = {r.neuron_id for r in registry.QUERIES["empty_neurons"](spark, SF).collect()}
    hit = {r.neuron_id for r in queries.scored(spark, SF).select("neuron_id").distinct().collect()}
    assert empty == set(range(17)) - hit and 16 in empty


def test_elbow_tries_the_default_range(spark):
    assert sorted(r.k for r in registry.QUERIES["elbow"](spark, SF).collect()) == list(range(2, 11))


def test_outer_merge_of_all_customers(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = {r.o_custkey for r in registry.QUERIES["outer_merge"](spark, SF).collect()}
    assert got == {r.o_custkey for r in orders.select("o_custkey").distinct().collect()}
