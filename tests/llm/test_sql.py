"""Registered queries against their SQL, over whole small tables."""

import duckdb
import pytest

from scopelens.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, data_dir, sql, name):
    df = QUERIES[name](spark, data_dir)
    found = sql.execute(ORACLE[name])
    columns = [entry[0] for entry in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [tuple(row[columns.index(c)] for c in df.columns) for row in found.fetchall()]

    def ordered(rows):
        return sorted((tuple(row) for row in rows), key=str)

    assert ordered(df.collect()) == ordered(expected)
