"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison on sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["documents", "embeddings", "conversations", "labels", "pages", "benchmark"]


def norm(v):
    if isinstance(v, float):
        return round(v, 4) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["project_id", "source", "target", "type", "line"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted([tuple(norm(x) for x in r) for r in df.collect()], key=key)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    order = [ocols.index(c) for c in cols]
    exp = sorted([tuple(norm(r[i]) for i in order) for r in res.fetchall()], key=key)
    assert got == exp


def test_rows_only_queries_run(spark):
    for name in set(E.queries()) - set(E.oracle_sql()):
        assert E.queries()[name](spark, SF_SMALL).count() >= 0
