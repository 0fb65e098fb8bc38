"""Combining results, and matching them with an expected list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scopelens.functions.labels import map_folded


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Duplicates are kept. A column that a part lacks is NULL there."""
    return reduce(lambda above, below: above.unionByName(below, allowMissingColumns=True), parts)


def present_in_order(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """The expected labels that occur, numbered by their place in the list."""
    place = map_folded(F.col(column), {label: place for place, label in enumerate(expected, start=1)})
    found = df.select(place.cast("int").alias("rank")).where(F.col("rank").isNotNull()).distinct()
    name = F.element_at(F.array(*[F.lit(label) for label in expected]).cast("array<string>"), F.col("rank"))
    return found.select(name.alias(column), "rank").orderBy("rank")
