"""Centroid clustering against exact comparison with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from scopelens.llm import centroids
from tests.llm.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string, distance double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "i", 0.5) for i, v in rows], SCHEMA)


def brute(rows, size=64, k=16, rounds=3):
    kept = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, own) in zip(kept, found, strict=True) if own == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = assign()
    inertia = {}
    for distance, n in found:
        inertia[n] = inertia.get(n, 0) + distance
    return sorted(
        (i, n, d, inertia[n], sum(inertia.values()), centroids.centroid_sha256(centres[n])) for (i, _), (d, n) in zip(kept, found, strict=True)
    )


def found(df):
    return sorted(tuple(row) for row in centroids.digest(centroids.cluster(df)).collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_equals_exact_comparison(spark, spread):
    source = np.random.default_rng(7)
    centres = source.standard_normal((9, 64))
    rows = [(k, (centres[k % 9] + spread * source.standard_normal(64)).astype(np.float32).tolist()) for k in range(400)]
    assert found(table(spark, rows)) == brute(rows)


def test_defined_cases(spark):
    source = random.Random(3)
    plain = [(k, [source.uniform(-1, 1) for _ in range(64)]) for k in range(40)]
    same = [(100 + k, plain[0][1]) for k in range(200)]  # a third in one spot, and ties
    odd = [
        (None, plain[1][1]),
        (50, None),
        (51, []),
        (52, [0.5] * 63),
        (53, [0.5] * 65),
        (54, [None, *[0.5] * 63]),
        (55, [float("nan"), *[0.5] * 63]),
        (56, [float("inf"), *[0.5] * 63]),
        (57, [0.0] * 64),
        (3, plain[3][1]),  # repeated row
        (4, plain[5][1]),  # same id, another vector
    ]
    rows = plain + same + odd
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, [])) == []
    assert found(table(spark, odd[1:8])) == []
    few = plain[:3] + [(9, plain[0][1])]
    assert found(table(spark, few)) == brute(few)


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        found(table(spark, [(1, [1e30] * 64)]))


def test_bounds_enclose_distances():
    source = np.random.default_rng(11)
    points, others = source.integers(-90, 90, (300, 64)), source.integers(-90, 90, (20, 64))
    simplex = centroids.Simplex.of(others)
    assert 4 <= len(simplex.pivots) <= centroids.PIVOTS
    exact = centroids._squares(points, others)
    a = simplex.apexes(centroids._squares(points, simplex.pivots))
    b = simplex.apexes(centroids._squares(others, simplex.pivots))
    lower = ((a[:, None] - b[None]) ** 2).sum(2)
    upper = lower + 4 * a[:, None, -1] * b[None, :, -1]
    assert (lower <= exact * (1 + 1e-9) + 1e-6).all() and (upper >= exact * (1 - 1e-9) - 1e-6).all()
    possible = centroids.candidates(a, b)
    assert possible[np.arange(len(points)), exact.argmin(1)].all()


def test_bounds_leave_out_most_centroids_of_clusters():
    source = np.random.default_rng(5)
    centres = source.integers(-60, 60, (16, 64))
    points = centres[source.integers(0, 16, 500)] + source.integers(-5, 6, (500, 64))
    simplex = centroids.Simplex.of(centres)
    possible = centroids.candidates(simplex.apexes(centroids._squares(points, simplex.pivots)), simplex.apexes(centroids._squares(centres, simplex.pivots)))
    assert possible.sum(1).mean() < 2


def test_degenerate_pivots():
    points = np.array([[0, 0], [2, 0], [4, 0], [4, 0], [1, 0]])
    simplex = centroids.Simplex.of(points)
    assert len(simplex.pivots) == 2
    assert len(centroids.Simplex.of(points[:1]).pivots) == 1


def test_registered_query_sums_its_distances(spark, tmp_path):
    source = np.random.default_rng(2)
    rows = [(k, source.standard_normal(64).astype(np.float32).tolist()) for k in range(60)]
    out = rows_of(centroids.cluster(table(spark, rows)), "vec_id", "cluster", "distance", "cluster_inertia", "inertia")
    assert len(out) == 60
    for cluster, _, own, total in out.values():
        assert own == sum(d for c, d, *_ in out.values() if c == cluster)
        assert total == sum(d for _, d, *_ in out.values())
