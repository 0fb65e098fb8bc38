"""Groups of rows that arrive sorted by a key within a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys; only one group is held at a time."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and parts[-1].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


class Sets:
    """Disjoint sets over 0..n-1."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y
