"""Every registered query runs; those with SQL give what DuckDB gives on the same tables."""

import duckdb
import pytest

from quarry import registry
from quarry.plans.book import NAMES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) else str(x) if isinstance(x, list | dict) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert canonical(rows, df.columns) == canonical(expected.fetchall(), expected.columns)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
