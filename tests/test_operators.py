from datetime import date

import pytest
from pyspark.sql import functions as F

from scopelens.operators import aggregate, filters, joins, pivot, rank, sets
from tests.conftest import tuples


def test_types_ignore_case_and_keep_accents(make_cases):
    cases = make_cases(*[{"case_type": t} for t in ("Reclamação", "RECLAMAÇÃO", "reclamacao", None)])
    assert filters.type_is(cases, "RECLAMAÇÃO").count() == 2
    assert filters.type_is_not(cases, "RECLAMAÇÃO").count() == 1


def test_null_group_is_neither_in_nor_not_in(make_cases):
    cases = make_cases(*[{"case_group": g} for g in ("x", "y", None)])
    assert filters.group_in(cases, ["X"]).count() == 1
    assert filters.group_not_in(cases, ["X"]).count() == 1


def test_month_filters(make_cases):
    cases = make_cases(*[{"month": f"2024-{m:02}"} for m in range(1, 7)])
    assert filters.in_month_range(cases, "2024-02", "2024-04").count() == 3
    assert filters.in_month(cases, "2024-06").count() == 1
    assert filters.in_optional_range(cases, "2024-02", None).count() == 6
    assert filters.in_optional_range(cases, "2024-02", "2024-02").count() == 1


def test_month_filter_on_the_event_date(spark):
    days = [date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 29), date(2024, 3, 1)]
    cases = spark.createDataFrame([(d.replace(day=1), d) for d in days], "month date, event_date date")
    assert filters.in_month(cases, "2024-02").count() == 2


def test_the_last_day_counts_to_its_end(spark):
    rows = spark.sql(
        "SELECT date'2024-03-01' AS month, m AS event_date FROM VALUES (timestamp'2024-03-31 15:00:00'), "
        "(timestamp'2024-03-01 00:00:00'), (NULL) AS t(m)"
    )
    assert filters.in_month(rows, "2024-03").count() == 3
    assert filters.in_month(rows, "2024-02").count() == 0


def test_drop_group_keeps_null(make_counts):
    counts = make_counts(("a", 2), ("Social", 3), (None, 1))
    assert sorted(tuples(filters.drop_group(counts, "label", "SOCIAL")), key=str) == [("a", 2), (None, 1)]


def test_not_null(make_counts):
    assert tuples(filters.not_null(make_counts(("a", 1), (None, 2)), ["label"])) == [("a", 1)]


def test_count_by_joins_case_variants(make_cases):
    cases = make_cases(*[{"reason": r} for r in ("Cor", "COR", "cor", "Côr", None)])
    assert sorted(tuples(aggregate.count_by(cases, "reason")), key=str) == [("COR", 3), ("Côr", 1), (None, 1)]


def test_constant_label_needs_rows(make_cases):
    cases = make_cases({"case_type": "s", "case_group": "y"})
    mentions = filters.group_in(cases, ["x"])
    assert tuples(aggregate.count_as(mentions, "case_type", "mentions", "case_type")) == []
    others = filters.group_not_in(cases, ["x"])
    assert tuples(aggregate.count_as(others, "case_type", "others", "case_type")) == [("others", 1)]


def test_sums_of_nothing(make_counts):
    empty = make_counts(("a", 1)).where("false")
    assert tuples(aggregate.sum_all(empty)) == [(None,)]
    assert tuples(aggregate.grand_total(empty)) == [(0,)]


def test_full_join_fills_zero(spark):
    a = spark.createDataFrame([("2024-01", 4), ("2024-02", 5), (None, 1)], "month string, a long")
    b = spark.createDataFrame([("2024-02", 6), ("2024-03", 7), (None, 2)], "month string, b long")
    found = sorted(tuples(joins.full_join_counts(a, b, "month")), key=str)
    assert found == [("2024-01", 4, 0), ("2024-02", 5, 6), ("2024-03", 0, 7), (None, 0, 2), (None, 1, 0)]


def test_lookup_default(spark, make_counts):
    dimension = spark.createDataFrame([("a", "red")], "label string, colour string")
    found = joins.lookup(make_counts(("a", 1), ("b", 2), (None, 3)), dimension, "label", "colour", "grey")
    assert sorted((r.total, r.colour) for r in found.collect()) == [(1, "red"), (2, "grey"), (3, "grey")]


REMAINDER_CASES = [
    # counts, n, expected top and remainder
    ([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2, [("a", 5, 0), ("b", 3, 0), ("rest", 4, 1)]),
    ([("a", 5), (None, 4), ("b", 1)], 2, [("a", 5, 0), (None, 4, 0)]),
    ([("a", 5), ("b", 4), (None, 1), ("c", 1)], 2, [("a", 5, 0), ("b", 4, 0), ("rest", 1, 1)]),
    ([("a", 5), ("b", 3)], 10, [("a", 5, 0), ("b", 3, 0)]),
    ([(None, 5)], 10, [(None, 5, 0)]),
    ([("a", 5), ("b", 4), (None, 1)], 2, [("a", 5, 0), ("b", 4, 0)]),
]


@pytest.mark.parametrize("counts, n, expected", REMAINDER_CASES)
def test_top_n_with_remainder(make_counts, counts, n, expected):
    found = rank.top_n_with_remainder(make_counts(*counts), "label", "rest", n)
    assert tuples(found.orderBy(*rank.report_order("label"))) == expected


@pytest.mark.parametrize("counts, n, expected", REMAINDER_CASES)
def test_remainder_equals_not_in(make_counts, counts, n, expected):
    frame = make_counts(*counts)
    summed = joins.sum_remainder(frame, rank.top_n(frame, "label", n), "label", "rest")
    rest = [(label, total, 1) for label, total in tuples(summed) if total is not None]
    assert rest == [row for row in expected if row[2] == 1]


def test_top_n_with_remainder_in_groups(spark):
    """Each group is what it would be alone."""
    rows = [(g, label, total) for g, (counts, _, _) in enumerate(REMAINDER_CASES) for label, total in counts]
    together = rank.top_n_with_remainder(
        spark.createDataFrame(rows, "g long, label string, total long"), "label", "rest", 2, by=["g"]
    )
    found = tuples(together.orderBy("g", *rank.report_order("label")))
    for g, (counts, _, _) in enumerate(REMAINDER_CASES):
        alone = rank.top_n_with_remainder(spark.createDataFrame(counts, "label string, total long"), "label", "rest", 2)
        assert [row[1:] for row in found if row[0] == g] == tuples(alone.orderBy(*rank.report_order("label")))


def test_cumulative_share(make_counts):
    ranked = rank.top_n_with_remainder(make_counts(("a", 5), ("b", 3), ("c", 3), ("d", 1)), "label", "rest", 2)
    found = rank.cumulative_share(ranked, rank.report_order("label")).orderBy("bucket", "label")
    assert [r.cum_share for r in found.collect()] == [5 / 12, 8 / 12, 1.0]


def test_cumulative_share_counts_ties_one_by_one(make_counts):
    ranked = rank.top_n_with_remainder(make_counts(("a", 1), ("b", 1), ("c", 2)), "label", "rest")
    found = rank.cumulative_share(ranked, rank.report_order("label")).orderBy(*rank.report_order("label"))
    assert [r.cum_share for r in found.collect()] == [2 / 4, 3 / 4, 1.0]


def test_share_of_total(make_counts):
    found = rank.share_of_total(make_counts(("a", 1), ("b", 3)))
    assert sorted(tuples(found)) == [("a", 1, 0.25), ("b", 3, 0.75)]


def test_explicit_order(make_counts):
    counts = make_counts(("Z", 1), ("y", 1), ("X", 1), ("other", 1), (None, 1))
    found = rank.sort_by_explicit_order(counts, "label", ["x", "Y", "z"])
    assert [(r.label, r["rank"]) for r in found.collect()] == [("X", 1), ("y", 2), ("Z", 3), (None, None), ("other", None)]


def test_remainder_last(make_counts):
    found = rank.remainder_last(make_counts(("rest", 9), ("a", 1), ("b", 5), (None, 2)), "label", "rest")
    assert [r.label for r in found.collect()] == ["b", None, "a", "rest"]


def test_row_numbers_follow_a_filter(make_counts):
    ranked = rank.top_n_with_remainder(make_counts(("a", 5), (None, 4), ("b", 1)), "label", "rest")
    found = rank.row_numbers(filters.not_null(ranked, ["label"]), rank.report_order("label"))
    assert sorted((r["rank"], r.label) for r in found.collect()) == [(1, "a"), (2, "b")]


def test_pivot(spark):
    counts = spark.createDataFrame(
        [("s1", "b1", 2), ("s1", None, 1), ("s2", None, 4)], "s string, b string, total long"
    )
    wide = pivot.pivot_counts(counts, "s", "b", ["b1", "b9"])
    assert wide.columns == ["s", "b1", "b9"]
    assert sorted(tuples(wide)) == [("s1", 2, 0), ("s2", 0, 0)]
    assert sorted(tuples(pivot.pivot_counts(counts, "s", "b", []))) == [("s1",), ("s2",)]


def test_pivot_columns_are_ordered_and_bounded(spark, make_counts):
    found = make_counts(("b", 1), ("a", 1), ("z", 1), (None, 1), ("c", 1))
    assert pivot.column_labels(found, "label", "b") == ["a", "c", "z", "b"]
    with pytest.raises(ValueError):
        pivot.column_labels(found, "label", "b", most=3)


def test_pivot_of_any_names(spark):
    counts = spark.createDataFrame([("x", "a.b", 1), ("x", "a`b", 2), ("y", "S", 3)], "s string, b string, total long")
    wide = pivot.pivot_counts(counts, "s", "b", ["a.b", "a`b", "S", "none.such"])
    assert wide.columns == ["s_", "a.b", "a`b", "S", "none.such"]
    assert tuples(rank.sort_by_position(wide, 2, "s_")) == [("x", 1, 2, 0, 0), ("y", 0, 0, 3, 0)]


def test_remainder_is_not_in(spark, make_counts):
    counts = make_counts(("a", 1), ("b", 2), (None, 3))
    assert tuples(joins.remainder_of(counts, make_counts(("a", 1)), "label")) == [("b", 2)]
    assert tuples(joins.remainder_of(counts, make_counts(("a", 1), (None, 1)), "label")) == []
    assert sorted(tuples(joins.remainder_of(counts, make_counts(("a", 1)).limit(0), "label"))) == [("a", 1), ("b", 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.remainder_of(counts, make_counts(("a", 1)), "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "NestedLoop" not in plan


def test_label_list(make_counts):
    labels = make_counts(("b", 1), ("a", 1), ("c", 1)).select("label")
    assert tuples(aggregate.ordered_label_list(labels, "label", "b", "list", 3)) == [("a, c, b",)]
    with pytest.raises(Exception, match="more than 2 values"):
        aggregate.ordered_label_list(labels, "label", "b", "list", 2).collect()


def test_sort_by_position(spark):
    df = spark.createDataFrame([("a", 1), ("c", 2), ("b", 2)], "s string, `x y` long")
    assert [r.s for r in rank.sort_by_position(df, 1, "s").collect()] == ["b", "c", "a"]
    narrow = df.select("s")
    assert rank.sort_by_position(narrow, 1, "s") is narrow


def test_union_keeps_duplicates(make_counts):
    assert sets.union_all([make_counts(("a", 1)), make_counts(("a", 1))]).count() == 2


def test_present_in_order(make_counts):
    found = sets.present_in_order(make_counts(("b", 1), ("A", 1), ("x", 1), (None, 1)), "label", ["B", "C", "a"])
    assert tuples(found) == [("B", 1), ("a", 3)]


def test_results_do_not_depend_on_partitioning(make_counts):
    counts = make_counts(*[(f"l{i % 40}", 7) for i in range(40)])
    expected = tuples(rank.top_n(counts, "label"))
    for parts in (1, 3, 7):
        assert tuples(rank.top_n(counts.repartition(parts, F.rand(parts)), "label")) == expected
