"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelens.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (id, component), the smallest id reachable; ids without links don't occur.

    Every round replaces links by links to smaller ids and is written to the shared folder. Rows of a
    node that many links meet in are pre-aggregated, or joined, where Spark splits a skewed side.
    """
    edges = _oriented(links.select("a", "b"))
    edges = stored(edges)
    seen = _state(edges)
    while True:
        edges = stored(_star(_star(edges, large=True), large=False))
        state = _state(edges)
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Large: larger neighbours of each node move to its smallest neighbour; small: the node and its smaller ones."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = near.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.where("b > node").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return _oriented(moved)
