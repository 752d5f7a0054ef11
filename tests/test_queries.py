"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__
from citesift.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in df[cols].astype(object).values)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_entry(spark):
    assert {r.status for r in __spark_entry__.entry(spark).collect()} == {"verified", "unknown-section", "unrecognised"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
