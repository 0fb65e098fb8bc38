"""Counts of thousands of scopes, by joins instead of a condition for each scope.

Scopes confined to a few columns with few values (``dimensions``) are the same for all cases with the same
values, so membership is a small table:

1. Distinct conditions are evaluated on the combinations of values that occur, ``WORD_BITS`` of them in a long
   at a time. No plan holds more than that many conditions, so code generation copes with any number.
2. A scope is the conditions it needs, as a mask for each word; it holds for a combination if all its masks do.
3. Combinations with the same scopes are one class, told by the bitmap of their scopes. Counts are summed by class
   first and only then given to its scopes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scopelens.model import SCOPE_ID, TOTAL
from scopelens.operators.joins import join_same
from scopelens.operators.sets import union_all
from scopelens.session import stored
from scopelens.sources.scopes import WORD_BITS, Scope, distinct_conditions

#: From so many scopes on, ``plans.counts`` tells them apart by these tables.
MANY_SCOPES = 200


def condition_words(combinations: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Which conditions each combination meets: rows of ``word`` (its number) and ``bits``."""
    parts = []
    for at in range(0, max(1, len(conditions)), WORD_BITS):
        bits = [f"if({condition}, {1 << place}L, 0L)" for place, condition in enumerate(conditions[at : at + WORD_BITS])]
        parts.append(combinations.withColumns({"word": F.lit(at // WORD_BITS), "bits": F.expr(" | ".join(bits) or "0L")}))
    return union_all(parts)


def scope_masks(scopes: Sequence[Scope], conditions: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """For each scope and each word it needs: id, number of its words, word, mask. A scope without conditions needs word 0."""
    places = {condition: place for place, condition in enumerate(conditions)}
    out = []
    for scope in scopes:
        masks: dict[int, int] = {}
        for condition in scope.conditions:
            word, bit = divmod(places[condition], WORD_BITS)
            masks[word] = masks.get(word, 0) | 1 << bit
        masks = masks or {0: 0}
        out += [(scope.scope_id, len(masks), word, mask) for word, mask in masks.items()]
    return out


def memberships(combinations: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    """The scopes of each combination of values: its columns and ``scope_id``, one row for each pair."""
    dimensions = combinations.columns
    conditions = distinct_conditions(scopes)
    masks = combinations.sparkSession.createDataFrame(scope_masks(scopes, conditions), f"{SCOPE_ID} int, words int, word int, mask long")
    met = condition_words(combinations, conditions).join(masks, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    held = met.groupBy(*dimensions, SCOPE_ID).agg(F.count(F.lit(1)).alias("held"), F.max("words").alias("words"))
    return held.where(F.col("held") == F.col("words")).select(*dimensions, SCOPE_ID)


def classes(pairs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Combinations with the ``class`` of those that have the same scopes: the hash of all bitmaps of their scopes."""
    place = F.col(SCOPE_ID).cast("long") + 1  # places start at 1
    bitmaps = pairs.groupBy(*dimensions, F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )
    own = F.sort_array(F.collect_list(F.struct("bucket", "bitmap")))
    # a combination's bitmaps are as many as scope ids differ by tens of thousands
    return bitmaps.groupBy(*dimensions).agg(F.sha2(F.to_json(own), 256).alias("class"))


def counts_by_scope(counts: DataFrame, scopes: Sequence[Scope], keys: Sequence[str]) -> DataFrame:
    """Counts by the scopes' dimensions and ``keys`` as counts by scope and ``keys``.

    The counts are kept first, so that the cases behind them are counted once.
    """
    dimensions, counts = list(scopes[0].dimensions), stored(counts)
    pairs = memberships(counts.select(*dimensions).distinct(), scopes)
    by_class = classes(pairs, dimensions)
    summed = join_same(counts, by_class, dimensions).groupBy(*keys, "class").agg(F.sum(TOTAL).alias(TOTAL))
    members = join_same(by_class, pairs, dimensions).select("class", SCOPE_ID).distinct()
    return summed.join(members, "class").groupBy(SCOPE_ID, *keys).agg(F.sum(TOTAL).alias(TOTAL)).select(SCOPE_ID, *keys, TOTAL)
