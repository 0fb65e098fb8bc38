"""The most frequent labels of a large table without counting all labels.

Counting every label shuffles a row for each label and task, which over many labels is as much as the table.
Two passes do with less where some labels are frequent:

1. Each task keeps a summary of at most ``tracked`` labels with counts that are too low by a bounded amount
   (frequent items, merged by Spark). The summary's labels are candidates; every other label occurs at most
   ``error * rows`` times.
2. The candidates, and only they, are counted exactly.

If the n-th candidate occurs more often than any other label can, the n largest are exact. If not (labels
are about equally frequent, or there are fewer candidates than asked for), all labels are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scopelens.functions.labels import fold
from scopelens.model import TOTAL
from scopelens.operators.rank import top_n

#: Labels a summary tracks. It holds 4 / 3 times as many at most, rounded up to a power of two.
TRACKED = 10_000


@dataclass(frozen=True)
class Summary:
    """Candidates, their rows' number in all, and how often a label that is no candidate can occur."""

    candidates: list[str]
    rows: int
    unseen: int


def summary(labels: DataFrame, label: str, tracked: int = TRACKED) -> Summary:
    """One row comes to the driver, with at most ``tracked`` labels."""
    slots = 1 << max(3, -(-tracked * 4 // 3) - 1).bit_length()
    found = labels.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{label}`, {tracked}, {tracked})").alias("items")
    ).first()
    items = found["items"] or []
    error = -(-found["rows"] * 7 // (2 * slots))  # 3.5 / slots of all rows
    if len(items) < min(tracked, slots * 3 // 4):
        # labels in the summary are left out where they may be errors; if it never had to drop one, it holds all
        return Summary([item["item"] for item in items], found["rows"], 0 if sum(item["count"] for item in items) == found["rows"] else 2 * error)
    return Summary([item["item"] for item in items], found["rows"], max(2 * error, items[-1]["count"] + error))


def top_n_two_phase(cases: DataFrame, label: Column, name: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The n largest groups of a label, compared as labels are; the NULL label counts like any other.

    The same rows as counting all labels gives. Runs two jobs before the result is known to be exact.
    """
    folded = cases.select(fold(label).alias(name))
    known = summary(folded, name, tracked)
    if len(known.candidates) >= n or not known.unseen:
        wanted = folded.sparkSession.createDataFrame([(item,) for item in known.candidates], f"`{name}` string")
        # at most ``tracked`` labels, and the NULL label beside them
        candidates = folded.join(F.broadcast(wanted), name, "left_semi").union(folded.where(F.col(name).isNull()))
        top = top_n(candidates.groupBy(name).agg(F.count(F.lit(1)).alias(TOTAL)), name, n)
        least = top.agg(F.min(TOTAL), F.count(F.lit(1))).first()
        if not known.unseen or (least[1] == n and least[0] > known.unseen):
            return top
    return top_n(folded.groupBy(name).agg(F.count(F.lit(1)).alias(TOTAL)), name, n)
