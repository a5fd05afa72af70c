"""Driver contract: entry runs; every oracle query agrees with DuckDB at sf0.001."""
import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_SMALL
from dwellframe.sources.tables import TABLES

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns and df.count() >= 0


def test_contract_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if round(v, 6) == 0 else round(v, 6))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert cols == sorted(dcols)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    drows = Counter(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in rel.fetchall())
    assert srows == drows
