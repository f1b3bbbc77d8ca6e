"""Every query with SQL against DuckDB on the smallest tables; the others must give rows, but for two that find nothing there."""

import duckdb
import pandas as pd
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def value(x):
    if x is None or x is pd.NA or x != x:
        return "null"
    kind = type(x).__name__
    return repr(float(x)) if kind.startswith("float") else str(int(x)) if kind.startswith(("int", "uint")) else str(x)


def rows(frame):
    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found) > 0 or name in ("contradictions", "page_outline")


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
