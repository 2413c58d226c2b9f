import duckdb
import pytest

from quarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir).select(*expected.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected.fetchall(), key=str)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    assert [kinds[t] for _, t in got.dtypes] == [str(t) for t in expected.types]
