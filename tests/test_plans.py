"""Every registered query: the same rows as its SQL, and a plan fit for large tables."""

import re

import duckdb
import pytest

import __spark_entry__ as registered
from harness.oracle import ORACLE
from harness.queries import QUERIES

TABLES = ("lineitem", "orders", "part")


@pytest.fixture(scope="module")
def sql(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_all_are_registered():
    assert QUERIES.items() <= registered.queries().items()
    assert ORACLE.items() <= registered.oracle_sql().items()


def test_entry(spark):
    assert registered.entry(spark).count() == 11


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data_dir, sql, name):
    df = QUERIES[name](spark, data_dir)
    found = sql.execute(ORACLE[name])
    columns = [entry[0] for entry in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [tuple(row[columns.index(c)] for c in df.columns) for row in found.fetchall()]
    assert ordered(tuple(row) for row in df.collect()) == ordered(expected)

    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|InPandas|InArrow", plan)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("r_") and "pack" not in n])
def test_the_period_reaches_the_scan(spark, data_dir, name):
    plan = QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_no_row_is_sorted_before_counting(spark, data_dir):
    """A text in an aggregation buffer would make Spark sort every case."""
    for name in ("r_complaint_pareto", "r_top_line_variant", "multi_scope_top", "r_type_breakdown"):
        assert "SortAggregate" not in QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def compiled(spark):
    """Whole-stage code generation as in production, which the other tests go without."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", ["r_type_breakdown", "r_complaint_pareto", "r_other_pareto", "r_category_brand"])
def test_each_table_is_read_once(spark, data_dir, compiled, name):
    """The remainder, shares and totals reuse the exchange of the counts."""
    df = QUERIES[name](spark, data_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "WholeStageCodegen" in final or "*(" in final
    for table in TABLES:
        assert len(re.findall(rf"Location: [^\n]*?{table}\.parquet", final)) <= 1
