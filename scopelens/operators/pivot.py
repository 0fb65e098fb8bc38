"""Turning counted (row, column) pairs into a table with one column per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.model import TOTAL

# Columns a wide table, or labels a one-row list, may have unless the caller says otherwise. A schema
# needs a bound; beyond it is an error, never a cut, and the long form has none.
MOST_LABELS = 10_000


def column_labels(labels: DataFrame, column: str, last: str, most: int = MOST_LABELS) -> list[str]:
    """The labels that become columns: ascending, the catch-all last.

    A schema must be known before the query is planned, so this is an action. It brings at most
    ``most`` labels to the driver; more is an error.
    """
    found = [row[0] for row in labels.select(named(column)).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}: use the long form")
    return sorted((name for name in found if name is not None), key=lambda name: (name == last, name))


def named(name: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def pivot_counts(
    counts: DataFrame, rows: str, columns: str, values: Sequence[str], value: str = TOTAL
) -> DataFrame:
    """One row per ``rows`` label, one column per entry of ``values``, 0 where nothing was counted.

    The entries may be any texts. The row column comes first; where an entry has its name, in any
    case, underscores are added to it, as no two columns can share a name.
    """
    taken = {name.lower() for name in values}
    shown = rows
    while shown.lower() in taken:
        shown += "_"
    if not values:
        return counts.select(named(rows)).distinct()
    cells = [F.coalesce(F.sum(F.when(named(columns) == F.lit(name), named(value))), F.lit(0)).alias(name) for name in values]
    return counts.groupBy(named(rows).alias(shown)).agg(*cells)


def pivot_map(counts: DataFrame, rows: str, columns: str, name: str = "cells", value: str = TOTAL) -> DataFrame:
    """One row per ``rows`` label with a map from column label to count.

    Needs no schema known before, so no labels come to the driver and nothing bounds their number. A label
    without count is not in the map; a NULL column label has no cell, but its row stays.
    """
    cells = counts.groupBy(named(rows).alias("_row"), named(columns).alias("_column")).agg(F.sum(named(value)).alias("_value"))
    entry = F.when(F.col("_column").isNotNull(), F.struct("_column", "_value"))
    listed = cells.groupBy("_row").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))
    return listed.withColumnRenamed("_row", rows)
