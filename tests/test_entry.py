import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["category", "severity", "incidents"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    mine = rows_of(df.columns, df.collect())
    assert mine
    if name in contract.oracle_sql():
        answer = db.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == sorted(df.columns)
        assert mine == rows_of(columns, answer.fetchall())
