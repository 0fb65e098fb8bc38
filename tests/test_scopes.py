from datetime import date

import pytest
from pyspark.sql import functions as F

from scopelens.model import Period
from scopelens.operators.filters import in_month
from scopelens.plans.counts import scope_counts
from scopelens.plans.reports import complaint_pareto
from scopelens.sources import scopes as s
from scopelens.sources.cases import FileSource, JdbcSource, TableSource, read_cases, write_cases
from scopelens.vocabulary import Taxonomy
from tests.conftest import tuples


def registry(dimensions=()):
    return (
        s.ScopeRegistry(dimensions)
        .add(1)
        .add(2, "channel = 'digital'", parent=1)
        .add(3, "month < DATE'2024-03-01' OR month IS NULL", parent=2)
        .add(4, "channel = 'phone'", parent=1)
    )


def rows(make_cases):
    return make_cases(
        *[
            {"channel": channel, "month": month, "subcat2": sub}
            for channel in ("digital", "phone", None)
            for month in ("2024-01", "2024-02", "2024-03", "2024-04")
            for sub in ("a", "b", None)
        ]
    )


def test_conditions_add_up_along_the_hierarchy(make_cases):
    cases, known = rows(make_cases), registry()
    assert [s.apply_scope(cases, known, i).count() for i in (1, 2, 3, 4)] == [36, 12, 6, 12]


def test_registry_rejects_mistakes():
    known = registry()
    with pytest.raises(KeyError):
        known.add(9, "true", parent=8)
    with pytest.raises(ValueError):
        known.add(1)
    with pytest.raises(KeyError):
        known.scope(99)


@pytest.mark.parametrize("dimensions", [(), ("channel", "month")])
def test_many_scopes_equal_each_alone(make_cases, dimensions):
    cases, known = rows(make_cases), registry(dimensions)
    period = Period.of("2024-02", "2024-04")
    together = scope_counts(cases, known.scopes(known.ids()), ["subcat2"], period)
    summed = together.groupBy("scope_id", "subcat2").agg(F.sum("total").alias("total"))
    for scope_id in known.ids():
        alone = scope_counts(cases, known.scope(scope_id), ["subcat2"], period)
        chosen = summed.where(F.col("scope_id") == scope_id).drop("scope_id")
        assert sorted(tuples(chosen), key=str) == sorted(tuples(alone), key=str)


@pytest.mark.parametrize("dimensions", [(), ("channel", "month")])
def test_more_scopes_than_a_word_has_bits(make_cases, dimensions):
    known = s.ScopeRegistry(dimensions)
    for i in range(130):
        known.add(i, f"month >= DATE'2024-01-01' + INTERVAL {i % 4} MONTH AND {i} = {i}")
    found = scope_counts(rows(make_cases), known.scopes(known.ids()), [], None)
    summed = dict(tuples(found.groupBy("scope_id").agg(F.sum("total"))))
    assert summed == {i: 36 - 9 * (i % 4) for i in range(130)}


def test_scope_label(spark):
    catalogue = spark.createDataFrame([(1, "[MARCA] produto/x"), (2, "b")], "scope_id int, name string")
    assert tuples(s.scope_label(catalogue, 1)) == [(1, "Marca Produto/X")]
    assert tuples(s.scope_label(catalogue, 3)) == []


def test_stored_cases_are_pruned_by_month(spark, make_cases, tmp_path):
    cases = rows(make_cases)
    path = str(tmp_path / "cases")
    write_cases(cases, path)
    back = read_cases(spark, FileSource(path))
    assert sorted(tuples(back.select(*cases.columns)), key=str) == sorted(tuples(cases), key=str)
    plan = back.where(F.col("month").between(F.lit(date(2024, 2, 1)), F.lit(date(2024, 2, 1))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(trunc(month" in text or "PartitionFilters: [isnotnull(trunc(month" in text, text


def test_columns_are_renamed_and_months_cut(spark):
    raw = spark.sql(
        """SELECT timestamp'2024-02-17 10:00:00' AS quando, 't' AS tipo, 'g' AS case_group, 'r' AS reason, 'b' AS brand,
                  's' AS subcat1, 's' AS subcat2, 'l' AS line, 'v' AS variant, 'x' AS channel"""
    )
    raw.createOrReplaceTempView("raw_cases")
    cases = read_cases(spark, TableSource("raw_cases"), {"month": "quando", "case_type": "tipo"})
    assert cases.first().month == date(2024, 2, 1)
    assert "channel" in cases.columns
    with pytest.raises(ValueError, match="case_type"):
        read_cases(spark, TableSource("raw_cases"), {"month": "quando"})


def test_csv_source(spark, tmp_path):
    spark.range(3).write.option("header", "true").csv(str(tmp_path / "c"))
    assert FileSource(str(tmp_path / "c"), "csv", {"header": "true"}).load(spark).count() == 3


def test_jdbc_reads_in_parallel():
    """Settings only: there is no database here."""
    source = JdbcSource("jdbc:x", "cases", "month", "2020-01-01", "2024-12-01", 60, {"user": "u"})
    assert source.settings() == {
        "url": "jdbc:x",
        "dbtable": "cases",
        "partitionColumn": "month",
        "lowerBound": "2020-01-01",
        "upperBound": "2024-12-01",
        "numPartitions": "60",
        "fetchsize": "10000",
        "user": "u",
    }


def test_scopes_from_rows(spark):
    kind = "scope_id int, parent_id int, condition string"
    known = s.ScopeRegistry.from_table(spark.createDataFrame([(3, 2, "b = 1"), (2, 1, "a = 1"), (1, None, None)], kind))
    assert known.scope(3).conditions == ("a = 1", "b = 1")
    with pytest.raises(KeyError, match="unknown parent 9"):
        s.ScopeRegistry.from_table(spark.createDataFrame([(1, 9, None)], kind))
    with pytest.raises(ValueError, match="circle"):
        s.ScopeRegistry.from_table(spark.createDataFrame([(1, 2, None), (2, 1, None)], kind))
    with pytest.raises(ValueError, match="already defined"):
        s.ScopeRegistry.from_table(spark.createDataFrame([(1, None, None), (1, None, "x = 1")], kind))
    with pytest.raises(ValueError, match="more than 1"):
        s.ScopeRegistry.from_table(spark.createDataFrame([(1, None, None), (2, None, None)], kind), most=1)


def test_stored_cases_with_a_day_are_pruned_too(spark, make_cases, tmp_path):
    cases = make_cases({"month": "2024-01", "reason": "a"}, {"month": "2024-02", "reason": "b"})
    path = str(tmp_path / "cases")
    write_cases(cases.withColumn("event_date", F.expr("timestamp(month) + interval 20 days")), path)
    back = read_cases(spark, FileSource(path))
    found = complaint_pareto(back, registry().scope(1), month="2024-02", taxonomy=Taxonomy(complaint="x"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in text and "trunc(month" in text.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert in_month(back, "2024-02").count() == 1


def test_moments_are_checked(spark, make_cases):
    make_cases({}).withColumn("event_date", F.lit("soon")).createOrReplaceTempView("odd_moments")
    with pytest.raises(ValueError, match="event_date"):
        read_cases(spark, TableSource("odd_moments"))
