"""Near-duplicate embeddings by sorted projection passes.

Each pass hashes a vector to ``bits`` signs of random projections; with those in front, vectors are put
in order, and a vector is compared with its neighbours in that order, window by window, as far as they
share the pass's hash. Pairs are verified by cosine in double precision, counted in the first pass that
puts them side by side, and joined to components across passes. Pairs are never listed: a task gives
back the number of links of each vector and the links of a spanning forest.

Two vectors of exactly the least cosine share a pass's hash with probability (1 - angle / pi)**bits;
``bits`` grows with the logarithm of the largest label's rows, so that unrelated vectors seldom meet,
and the number of passes follows such that a link is missed with probability ``miss``. Runs of
vectors with equal hash longer than ``SIDE`` are cut into parts, every two of which meet in a cell of
their own. Equal vectors of a label are compared once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
so do those with a null label or of different lengths; rows with a null id are left out; of rows with the same id the one with
the least label and vector counts, and one row is returned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelens.llm.components import components
from scopelens.llm.groups import Sets, groups
from scopelens.llm.tables import stored

#: Vectors of a part, and neighbours looked at in one step.
SIDE, WINDOW = 512, 128
#: Bits of a hash beyond the logarithm of the rows.
SPARE_BITS = 8


@lru_cache(maxsize=8)
def _planes(size: int, count: int) -> np.ndarray:
    return np.random.default_rng([20240229, size]).standard_normal((size, count))


def _hashed(bits: int, passes: int):
    weights = np.left_shift(1, np.arange(bits - 1, -1, -1), dtype=np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(column.value_lengths())
            flat = np.asarray(column.flatten(), np.float64)
            ends = np.cumsum(sizes)
            codes = np.zeros((len(sizes), passes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                vectors = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                signs = vectors @ _planes(size, bits * passes) > 0
                codes[rows] = signs.reshape(len(rows), passes, bits) @ weights
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*batch.schema.names, "codes"]
            )

    return hashed


def _linked(cosine: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, "cell"):
            turn = cell.column("turn")[0].as_py()
            codes = np.asarray(cell.column("codes").combine_chunks().flatten()).reshape(cell.num_rows, -1)
            vectors = np.asarray(cell.column("vector").combine_chunks().flatten(), np.float64).reshape(cell.num_rows, -1)
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            ids, copies, side, kind = (np.asarray(cell.column(c)) for c in ("id", "copies", "side", "kind"))
            # by the hashes of all passes, this one's first: neighbours are alike
            order = np.lexsort((ids, *np.roll(codes, -turn, axis=1).T[::-1]))
            codes, vectors, ids, copies, side, kind = codes[order], vectors[order], ids[order], copies[order], side[order], kind[order]
            cross = cell.column("cross")[0].as_py()
            links, sets = np.zeros(len(ids), np.int64), Sets(len(ids))
            a, b = [], []
            for start in range(0, len(ids), WINDOW):
                for other in range(start, len(ids), WINDOW):
                    near = vectors[start : start + WINDOW] @ vectors[other : other + WINDOW].T >= cosine
                    x, y = np.nonzero(near)
                    x, y = x + start, y + other
                    met = (x < y) & (kind[x] == kind[y]) & (codes[x, turn] == codes[y, turn])
                    if cross:
                        met &= side[x] != side[y]
                    x, y = x[met], y[met]
                    first = (codes[x] == codes[y]).argmax(1) == turn  # else counted in an earlier pass
                    x, y = x[first], y[first]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    for k, other_k in zip(x.tolist(), y.tolist(), strict=True):
                        if sets.union(k, other_k):
                            a.append(ids[k])
                            b.append(ids[other_k])
            some = np.flatnonzero(links)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), none], ["id", "links", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], ["id", "links", "other"])

    return linked


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, miss: float = 1e-6
) -> DataFrame:
    """One row per id: id, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = named.where("id is not null").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.*")
    usable = (
        F.col("label").isNotNull()
        & F.exists("vector", lambda x: x != 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = stored(rows.withColumn("usable", F.coalesce(usable, F.lit(False))))
    keys = ["label", F.xxhash64("vector").alias("hash"), "vector"]
    classes = rows.where("usable").groupBy(*keys).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    most = rows.where("usable").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = min(62, math.ceil(math.log2(most + 1)) + SPARE_BITS)
    together = (1 - math.acos(cosine) / math.pi) ** bits
    passes = math.ceil(math.log(miss) / math.log(1 - together))

    hashed = classes.select(F.col("class_id").alias("id"), "label", "copies", "vector").mapInArrow(
        _hashed(bits, passes), f"id long, label {dict(rows.dtypes)['label']}, copies long, vector array<double>, codes array<long>"
    )
    hashed = stored(hashed)
    run = ["label", "size", "turn", "code"]
    placed = hashed.select("id", "label", F.size("vector").alias("size"), F.posexplode("codes").alias("turn", "code"))
    runs = placed.groupBy(*run).agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"), F.count("*").alias("count")).where("count > 1")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    meeting = placed.join(runs.drop("count"), run).withColumn("part", part)
    cell = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(
            F.xxhash64(*run, F.least("part", k), F.greatest("part", k)).alias("cell"), F.when(F.col("part") <= k, 0).otherwise(1).alias("side"), (F.col("part") != k).alias("cross")
        ),
    )
    cells = meeting.select("id", "turn", F.xxhash64("label", "size").alias("kind"), F.explode(cell).alias("at")).select("id", "turn", "kind", "at.*")
    whole = cells.join(hashed.select("id", "copies", "vector", "codes"), "id")
    count = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole.sparkSession.sparkContext.defaultParallelism)
    found = stored(
        whole.repartition(count, "cell").sortWithinPartitions("cell").mapInArrow(_linked(cosine), "id long, links long, other long")
    )
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))

    by_class = classes.join(links.withColumnRenamed("id", "class_id"), "class_id", "left").join(
        joined.withColumnRenamed("id", "class_id"), "class_id", "left"
    )
    out = rows.withColumn("hash", F.xxhash64("vector")).join(by_class, ["label", "hash", "vector"], "left")
    n_links = F.when(F.col("usable"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    component = F.when(F.col("usable"), F.coalesce("component", "class_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(vec_id), n_links.alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
