"""Counting.

Rows are first counted by their raw columns. That keeps the pass over the cases to a scan and a
hash aggregate with a long buffer (``min`` over a text cannot be hash-aggregated and would sort
every row), pre-aggregates before the shuffle whatever the skew, and leaves labels to be computed
once per group instead of once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.functions.labels import fold
from scopelens.model import TOTAL


def count_rows(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain count by raw columns, case variants apart."""
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias(TOTAL))


def count_by_expr(cases: DataFrame, keys: Sequence[str], label: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Count by a label computed from the columns ``keys``, case variants together.

    The least of the spellings is shown.
    """
    return merge_labels(count_rows(cases, [*by, *keys]), label, name, by)


def count_by(cases: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return count_by_expr(cases, [column], F.col(column), column, by)


def merge_labels(counts: DataFrame, label: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Counted rows summed by label, ignoring case."""
    return (
        counts.select(*by, label.alias("_label"), TOTAL)
        .groupBy(*by, fold(F.col("_label")).alias("_key"))
        .agg(F.min("_label").alias(name), F.sum(TOTAL).alias(TOTAL))
        .drop("_key")
    )


def count_as(cases: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Count under one constant label. The cases are filtered to one ``key``; none give no row."""
    grouped = cases.groupBy(fold(F.col(key))).agg(F.count(F.lit(1)).alias(TOTAL))
    return grouped.select(F.lit(label).alias(name), TOTAL)


def sum_all(counts: DataFrame, value: str = TOTAL) -> DataFrame:
    """One row always; NULL if there was nothing to sum."""
    return counts.agg(F.sum(value).alias(value))


def grand_total(result: DataFrame, values: Sequence[str] = (TOTAL,), by: Sequence[str] = ()) -> DataFrame:
    """Total over one or more series of a result, 0 if it is empty."""
    series = [F.coalesce(F.sum(value), F.lit(0)) for value in values]
    total = series[0]
    for more in series[1:]:
        total = total + more
    return result.groupBy(*by).agg(total.alias("grand_total"))


def distinct_labels(cases: DataFrame, column: str) -> DataFrame:
    return cases.select(column).where(F.col(column).isNotNull()).distinct()


def ordered_label_list(labels: DataFrame, column: str, last: str, name: str, at_most: int) -> DataFrame:
    """Distinct labels as one delimited text, the catch-all ``last``.

    The text is for a header, so more than ``at_most`` labels is an error, never a cut list.
    """
    entry = F.struct((F.col(column) == F.lit(last)).cast("int").alias("bucket"), F.col(column).alias("label"))
    entries = labels.select(column).distinct().limit(at_most + 1).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    too_many = F.raise_error(F.lit(f"more than {at_most} values of {column}"))
    checked = F.when(F.size("entries") > at_most, too_many.cast("string"))
    return entries.select(
        checked.otherwise(F.array_join(F.transform("entries", lambda e: e["label"]), ", ")).alias(name)
    )
