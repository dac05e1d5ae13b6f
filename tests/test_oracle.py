"""Every query with an oracle text equals DuckDB on the sf0.01 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from contactlens.plans import registry

# the queries over training data are compared in a test folder of their own
KEYS = sorted(registry.ORACLE)
TABLES = ["orders", "lineitem", "customer", "nation", "region", "supplier", "part"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)),
                        key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    got = E.queries()[key](spark, SF001).toPandas()
    want = con.execute(E.oracle_sql()[key]).fetchdf()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["variable", "value", "deposit", "count", "total", "percent"]
