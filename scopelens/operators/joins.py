"""Joins of counted results, and attribute lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scopelens.model import TOTAL


def full_join_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two counted frames side by side. What one lacks counts 0; NULL keys stay apart."""
    counts = [c for c in left.columns + right.columns if c != on]
    return left.join(right, on, "full").na.fill(0, subset=counts)


def remainder_of(counts: DataFrame, top: DataFrame, label: str) -> DataFrame:
    """Groups whose label is not among ``top``, which must be a top-n result.

    This is SQL's NOT IN: a NULL label is never in the remainder, and a NULL in ``top`` leaves
    nothing. Spark would always broadcast ``top`` for NOT IN; as an anti join on the labels beside one
    row that says whether ``top`` holds a NULL, the join is Spark's to choose. Over an empty ``top``
    everything with a label is left. Reports take the remainder from ``top_n_with_remainder`` instead, which
    needs no join.
    """
    labels = top.select(label)
    holds_null = labels.agg(F.coalesce(F.bool_or(F.col(label).isNull()), F.lit(False)).alias("holds_null")).scalar()
    named = counts.where(F.col(label).isNotNull() & ~holds_null)
    return named.join(labels.where(F.col(label).isNotNull()).distinct(), label, "left_anti").select(*counts.columns)


def sum_remainder(counts: DataFrame, top: DataFrame, label: str, name: str, value: str = TOTAL) -> DataFrame:
    rest = remainder_of(counts, top, label).agg(F.sum(value).alias(value))
    return rest.select(F.lit(name).alias(label), value)


def lookup(df: DataFrame, dimension: DataFrame, key: str, attribute: str, default: object | None = None) -> DataFrame:
    """Adds one attribute per key from a dimension with one row per key.

    No broadcast hint: Spark broadcasts the dimension if its size allows, and shuffles otherwise.
    """
    joined = df.join(dimension.select(key, attribute), key, "left")
    if default is None:
        return joined
    return joined.withColumn(attribute, F.coalesce(attribute, F.lit(default)))


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys, NULL equal to NULL; the keys come once. Both sides may stem from one frame."""
    renamed = {name: f"_other_{name}" for name in on}
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in renamed.items()]
    return left.join(right.withColumnsRenamed(renamed), same, how).drop(*renamed.values())
