"""Ranking, remainders, shares and report order.

Ties are broken by label, NULL first, so results do not depend on the partitioning. ``by`` names
the columns that tell reports apart when several are computed in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scopelens.functions.labels import map_folded
from scopelens.model import TOTAL
from scopelens.operators.pivot import named

BUCKET = "bucket"


def top_n(counts: DataFrame, label: str, n: int = 10, by: Sequence[str] = (), value: str = TOTAL) -> DataFrame:
    """The n largest groups. Each task keeps n before anything is shuffled."""
    order = [F.col(value).desc(), F.col(label).asc_nulls_first()]
    if not by:
        return counts.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def top_n_with_remainder(
    counts: DataFrame,
    label: str,
    remainder: str,
    n: int = 10,
    by: Sequence[str] = (),
    value: str = TOTAL,
) -> DataFrame:
    """The n largest groups (bucket 0) and the sum of the others in one row (bucket 1).

    Labels that are NULL are never part of the remainder, and a NULL among the n leaves none: the
    remainder is what NOT IN selects. It is taken as the sum of all minus the sum of the n, so the
    full ranking is never built; the window sees at most n + 1 rows per report.
    """
    top = top_n(counts, label, n, by, value).select(*by, label, value, F.lit(0).alias(BUCKET))
    named = F.when(F.col(label).isNotNull(), F.col(value))
    everything = counts.groupBy(*by).agg(F.sum(named).alias(value))
    both = top.unionByName(everything.select(*by, F.lit(remainder).alias(label), value, F.lit(1).alias(BUCKET)))

    report = Window.partitionBy(*by)
    in_top = F.col(BUCKET) == 0
    listed = F.sum(F.when(in_top, F.col(value))).over(report)
    null_listed = F.max(in_top & F.col(label).isNull()).over(report)
    rest = F.when(~F.col("_null_listed"), F.col(value) - F.col("_listed"))
    return (
        both.withColumns({"_listed": listed, "_null_listed": null_listed})
        .withColumn(value, F.when(in_top, F.col(value)).otherwise(rest))
        .where(in_top | (F.col(value) > 0))
        .select(*by, label, value, BUCKET)
    )


def report_order(label: str, value: str = TOTAL) -> list[Column]:
    """Remainder last, larger first."""
    return [F.col(BUCKET).asc(), F.col(value).desc(), F.col(label).asc_nulls_first()]


def row_numbers(report: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Numbers the rows of a report, which is a top-n result: n + 1 rows at most for each ``by``."""
    return report.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cumulative_share(
    report: DataFrame,
    order: Sequence[Column],
    value: str = TOTAL,
    name: str = "cum_share",
    by: Sequence[str] = (),
) -> DataFrame:
    """Running share of a report's total, in report order (a top-n result, as for row_numbers).

    Whole numbers are summed and then divided, so the last row is exactly 1. The frame counts rows:
    the default range frame would give tied rows the same share.
    """
    whole = Window.partitionBy(*by)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return report.withColumn(name, F.sum(value).over(running) / F.sum(value).over(whole))


def share_of_total(counts: DataFrame, value: str = TOTAL, name: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """Each row's part of the total, over any number of rows.

    The total is an aggregate of its own (scalar subquery, or join on ``by``) that reuses the
    counts' exchange; a window would bring all rows of a report into one task.
    """
    if not by:
        total = counts.agg(F.sum(value)).scalar()
        return counts.withColumn(name, F.col(value) / total)
    totals = counts.groupBy(*by).agg(F.sum(value).alias("_whole"))
    return counts.join(totals, list(by)).withColumn(name, F.col(value) / F.col("_whole")).drop("_whole")


def explicit_rank(label: Column, order: Sequence[str]) -> Column:
    """Place of a label in the list, compared as labels are; NULL for others."""
    return map_folded(label, {name: place for place, name in enumerate(order, start=1)})


def sort_by_explicit_order(df: DataFrame, label: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Known labels in list order, then the others by label."""
    ranked = df.withColumn(name, explicit_rank(F.col(label), order).cast("int"))
    return ranked.orderBy(F.col(name).asc_nulls_last(), F.col(label).asc_nulls_first())


def remainder_last(df: DataFrame, label: str, remainder: str, value: str = TOTAL) -> DataFrame:
    flagged = df.withColumn(BUCKET, F.coalesce(F.col(label) == F.lit(remainder), F.lit(False)).cast("int"))
    return flagged.orderBy(*report_order(label, value))


def sort_by_position(df: DataFrame, position: int, label: str) -> DataFrame:
    """Largest first by the column at a position; a frame too narrow for it stays as it is."""
    return df.orderBy(*position_order(df, position, label)) if len(df.columns) > position else df


def position_order(df: DataFrame, position: int, label: str) -> list[Column]:
    """Largest first by the column at a position, if there is one, then by label."""
    at = [named(df.columns[position]).desc()] if len(df.columns) > position else []
    return [*at, named(label).asc_nulls_first()]


def sort_asc(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(key).asc_nulls_first())
