"""Every query with an oracle gives the rows that DuckDB gives for its SQL."""

import math

import duckdb
import pytest

from massloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = {"mutations"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("benchmark", "customer", "documents", "embeddings", "events", "lineitem", "orders", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    out = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_are_no_nested_loops(spark):
    for name in ("precursor_range_join", "multi_window_range_join"):
        text = plan(QUERIES[name](spark, DATA))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top50_candidates"](spark, DATA))
