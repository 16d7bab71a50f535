"""Every registered core query that has an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lenswright.plans import catalogue

from .conftest import DATA

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _rows(rows, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_the_oracle(spark, db, name):
    df, rel = QUERIES[name](spark, DATA), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.toArrow().to_pylist(), df.columns) == _rows(rel.to_arrow_table().to_pylist(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_an_oracle(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
