"""Every query of the subpackage with a SQL text equals DuckDB on the sf0.01 tables."""

import duckdb
import pytest

from conftest import SF001
from contactlens.llm import queries

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_duckdb(spark, con, key):
    got = queries.QUERIES[key](spark, SF001).toPandas()
    want = con.execute(queries.ORACLE[key]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    rows = lambda pdf: sorted((tuple(None if v is None or v != v else v for v in r)
                               for r in pdf[cols].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
