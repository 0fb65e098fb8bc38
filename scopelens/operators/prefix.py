"""Places and running sums over any number of rows.

A window over a whole result runs in one task. Here rows are dealt to ranges of their order; each range is
numbered and summed by itself, and starts from the sums of the ranges before it, of which there is one row
for each range. A group (``by``) of any size is spread over as many ranges as it takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scopelens.model import TOTAL
from scopelens.operators.joins import join_same
from scopelens.operators.pivot import named
from scopelens.session import stored

_RANGE, _ROWS, _SUM = "_range", "_rows", "_sum"


def ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The rows dealt to ranges of (``by``, order) and kept, so that every reader sees the same ranges.

    Runs a job; the rows go to the shared folder.
    """
    session = df.sparkSession
    count = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return stored(df.repartitionByRange(count, *by, *order).withColumn(_RANGE, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Each row's place in an order, which must be total for the places to be definite."""
    return _placed(ranged(df, order, by), order, by, None).withColumnRenamed(_ROWS, name).drop(_RANGE, _SUM)


def running(df: DataFrame, order: Sequence[Column], value: str = TOTAL, by: Sequence[str] = (), place: str = "rank", name: str = "running") -> DataFrame:
    """Each row's place, and the sum of a whole-number column up to and with it."""
    placed = _placed(ranged(df, order, by), order, by, value)
    return placed.withColumnsRenamed({_ROWS: place, _SUM: name}).drop(_RANGE)


def _placed(rows: DataFrame, order: Sequence[Column], by: Sequence[str], value: str | None) -> DataFrame:
    counted = F.col(value) if value else F.lit(0)
    within = Window.partitionBy(_RANGE, *by).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumns({_ROWS: F.row_number().over(within).cast("long"), _SUM: F.coalesce(F.sum(counted).over(so_far), F.lit(0))})
    # one row for each range, and for each group that ends in it
    sums = rows.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(counted), F.lit(0)).alias("sum"))
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, _RANGE, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}_before") for name in ("rows", "sum")])
    joined = join_same(inner, offsets, [_RANGE, *by])
    return joined.select(*map(named, rows.columns), (F.col(_ROWS) + F.col("_rows_before")).alias(_ROWS), (F.col(_SUM) + F.col("_sum_before")).alias(_SUM))


def pareto_classes(
    counts: DataFrame, label: str, value: str = TOTAL, by: Sequence[str] = (), bounds: Sequence[tuple[str, float]] = (("A", 0.8), ("B", 0.95)), rest: str = "C"
) -> DataFrame:
    """All labels by size with their rank, running share and class, however many there are.

    A label belongs to the first class whose bound the share before it has not reached, so the label that
    crosses a bound still belongs to that class.
    """
    order = [F.col(value).desc(), F.col(label).asc_nulls_first()]
    placed = running(counts, order, value, by, name="_running")
    whole = placed.groupBy(*by).agg(F.max("_running").alias("_whole"))
    if by:
        placed = join_same(placed, whole, by)
    else:
        placed = placed.withColumn("_whole", whole.scalar())
    before = (F.col("_running") - F.col(value)) / F.col("_whole")
    chain = F.lit(rest)
    for name, bound in reversed(bounds):
        chain = F.when(before < bound, name).otherwise(chain)
    return placed.select(*by, F.col("rank"), label, value, (F.col("_running") / F.col("_whole")).alias("cum_share"), chain.alias("class"))
