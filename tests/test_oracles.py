"""Every SQL-checked query against its DuckDB oracle on the smallest fixture (sf0.001)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = sorted(tuple(_norm(v) for v in r) for r in df.collect()) if df.columns else []
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == sorted(df.columns)
    perm = [dcols.index(c) for c in df.columns]
    drows = sorted(tuple(_norm(r[i]) for i in perm) for r in rel.fetchall())
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(srows, key=key) == sorted(drows, key=key)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["column_idx", "column_name"]
