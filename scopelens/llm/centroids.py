"""Centroid clustering in whole numbers, with centroids filtered by n-simplex projection.

Vectors become whole numbers, and their distances to a few pivots are computed once and kept as the
coordinates of an apex: the pivots span a simplex, and a vector whose distances to them are known lies
over it at a known foot and altitude. For two apexes with coordinates (foot, altitude)

    lower bound   distance of the apexes, altitudes on one side
    upper bound   distance of the apexes, altitudes on opposite sides

enclose the true distance. A round computes the apexes of the centroids, leaves out every centroid whose
lower bound is above the least upper bound, and compares the rest exactly, in 64-bit whole numbers.
Bounds are floating-point and widened by ``SLACK``, so that rounding cannot leave out the nearest one.

Pivots are chosen among the first centroids, each farthest over the simplex of those before, as long as
it stands out by ``LEAST_ALTITUDE`` of the widest distance; that keeps the projection well conditioned.

A round moves no vectors: tasks return sums for each cluster and component, which Spark adds up;
``k`` times ``size`` numbers reach the driver. Vectors and their apexes are written to the shared folder once.

Defined cases: rows with a null id, and vectors that are null, of another size, or hold null or
non-finite components, are left out; repeated rows are vectors of their own, and of rows with one id
the one with the smaller vector comes first; with fewer than ``k`` vectors there are as many centroids;
an empty table gives no rows; other columns are ignored. Components beyond +-2**21 raise an
error, as squared distances then do not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelens.llm.tables import stored

#: Pivots at most, the altitude a further pivot needs, and the widening of bounds; relative to distances.
PIVOTS, LEAST_ALTITUDE, SLACK = 12, 0.05, 1e-8
#: Vectors whose bounds are computed together, and the largest whole number of a component.
TOGETHER, LARGEST = 4096, 1 << 27


@dataclass
class Simplex:
    """Pivots, and what turns distances to them into an apex."""

    pivots: np.ndarray  # int64, pivots by components
    solve: np.ndarray  # inverse of the pivots' own coordinates
    norms: np.ndarray  # squared distances of the pivots to the first

    @classmethod
    def of(cls, points: np.ndarray, most: int = PIVOTS) -> Simplex:
        apart = _squares(points, points).astype(np.float64)
        first = int(apart.sum(1).argmax()) if len(points) else 0
        chosen, rows = [first], [np.zeros(0)]
        widest = float(apart.max()) if len(points) else 0.0
        while len(chosen) < min(most, len(points)):
            feet = np.zeros((len(points), len(chosen) - 1))
            for k in range(1, len(chosen)):
                inner = (apart[:, first] + rows[k] @ rows[k] - apart[:, chosen[k]]) / 2
                feet[:, k - 1] = (inner - feet[:, : k - 1] @ rows[k][: k - 1]) / rows[k][k - 1]
            over = apart[:, first] - (feet**2).sum(1)
            over[chosen] = 0
            best = int(over.argmax())
            if over[best] <= LEAST_ALTITUDE**2 * widest or over[best] <= 0:
                break
            rows = [np.append(row, 0.0) for row in rows]
            rows.append(np.append(feet[best], np.sqrt(over[best])))
            chosen.append(best)
        base = np.array(rows[1:]).reshape(len(chosen) - 1, len(chosen) - 1)
        return cls(points[chosen], np.linalg.inv(base), (base**2).sum(1))

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots; the last is the altitude."""
        squares = squares.astype(np.float64)
        feet = (squares[:, :1] - squares[:, 1:] + self.norms) / 2 @ self.solve.T
        return np.column_stack([feet, np.sqrt(np.maximum(squares[:, 0] - (feet**2).sum(1), 0))])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all of ``a`` to all of ``b``."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def candidates(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """True where a centroid may be the nearest: its lower bound is not above the least upper bound."""
    norms, others = (apexes**2).sum(1)[:, None], (centres**2).sum(1)[None]
    lower = norms + others - 2 * apexes @ centres.T
    upper = lower + 4 * apexes[:, -1:] * centres[None, :, -1]
    slack = SLACK * (norms + others) + SLACK
    return lower - slack <= (upper + slack).min(1, keepdims=True)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of each vector's nearest centroid; of equal ones the first."""
    centres = simplex.apexes(_squares(centroids, simplex.pivots))
    number, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.iinfo(np.int64).max)
    for start in range(0, len(vectors), TOGETHER):
        part = slice(start, start + TOGETHER)
        possible = candidates(apexes[part], centres)
        for k in range(len(centroids)):
            rows = np.flatnonzero(possible[:, k]) + start
            distance = ((vectors[rows] - centroids[k]) ** 2).sum(1)
            closer = distance < least[rows]
            number[rows[closer]], least[rows[closer]] = k, distance[closer]
    return number, least


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def _projected(simplex: Simplex, size: int):
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), size, np.int64)
            apexes = simplex.apexes(_squares(vectors, simplex.pivots))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(apexes), pa.list_(pa.float64()))], ["id", "vector", "apex"])

    return projected


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, simplex: Simplex):
    vectors = _matrix(batch.column("vector"), centroids.shape[1], np.int64)
    apexes = _matrix(batch.column("apex"), len(simplex.pivots), np.float64)
    return vectors, *nearest(vectors, apexes, centroids, simplex)


def _sums(centroids: np.ndarray, simplex: Simplex):
    """Vectors of each cluster and the sums of their components, one row for each cluster of a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            vectors, number, _ = _assigned(batch, centroids, simplex)
            counts += np.bincount(number, minlength=len(centroids))
            np.add.at(total, number, vectors)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "count", "sums"]
        )

    return sums


def _labelled(centroids: np.ndarray, simplex: Simplex):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, number, distance = _assigned(batch, centroids, simplex)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return labelled


def moved(projected: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Each centroid's floored mean; one without vectors stays."""
    sums = projected.mapInArrow(_sums(centroids, simplex), "cluster int, count long, sums array<long>")
    per_component = sums.select("cluster", "count", F.posexplode("sums").alias("component", "sum"))
    means = per_component.groupBy("cluster", "component").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    out = centroids.copy()
    for row in means.collect():  # at most one row for each component of a centroid
        out[row["cluster"], row["component"]] = row["sum"] // row["count"]
    return out


def whole_numbers(vectors: DataFrame, *, vec_id: str, vector: str, size: int, scale: float) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part, components as floor(scale * x)."""
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = (
        F.col("id").isNotNull()
        & (F.size("vector") == size)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    whole = F.transform(
        "vector", lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    )
    return named.where(F.coalesce(usable, F.lit(False))).select("id", whole.alias("vector"))


def cluster(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, salt: str = "1"
) -> DataFrame:
    """One row per vector: id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (array of long).

    The first centroids are the ``k`` vectors with the smallest sha256 of ``salt:id``.
    """
    whole = whole_numbers(vectors, vec_id=vec_id, vector=vector, size=size, scale=scale)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    firsts = whole.select(order.alias("order"), "vector").orderBy("order", "vector").limit(k).collect()
    centroids = np.array([row["vector"] for row in firsts], np.int64).reshape(len(firsts), size)
    schema = f"`{vec_id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    simplex = Simplex.of(centroids)
    projected = stored(whole.mapInArrow(_projected(simplex, size), "id long, vector array<long>, apex array<double>"))
    for _ in range(rounds):
        centroids = moved(projected, centroids, simplex)
    labelled = stored(projected.mapInArrow(_labelled(centroids, simplex), "id long, cluster int, distance long"))
    inertia = {row["cluster"]: row["inertia"] for row in labelled.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(inertia.values())
    rows = [(number, own, total, centroids[number].tolist()) for number, own in inertia.items()]  # one for each cluster
    clusters = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return labelled.withColumnRenamed("id", vec_id).join(F.broadcast(clusters), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clusters: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    spelled = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return clusters.select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", F.sha2(spelled, 256).alias("centroid_sha256"))


def centroid_sha256(centroid: list[int]) -> str:
    """The digest of one centroid, as ``digest`` gives it."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
