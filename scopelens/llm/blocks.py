"""Texts of an Arrow column as blocks of bytes, for vectorised work inside a task.

A block holds the UTF-8 bytes of some consecutive rows, at most ``limit`` bytes unless a single
text is longer. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from scopelens.llm.memory import forgets

LIMIT = (1 << 21) - 2


@dataclass
class Block:
    first: int  # row of the column where the block begins
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(column: pa.Array, limit: int = LIMIT) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true that stay within a row."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    filled = offsets[:-1] < offsets[1:]
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][filled]] = False
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][filled] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each start, and where each row's starts begin and end in the list of starts."""
    bounds = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: Powers of the base and of its inverse modulo 2**64; longer tables replace shorter ones.
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the base and of its inverse."""
    if len(_tables[0]) < size:
        whole = 1 << max(18, (size - 1).bit_length())
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(whole, factor, np.uint64)
            table[0] = 1
            _tables[k] = np.multiply.accumulate(table)
    return _tables[0], _tables[1]


def _forget() -> None:
    _tables[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


forgets(_forget)


class Hashes:
    """Hashes of substrings of a block from one pass over its bytes."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive hashes; windows over a row's end are for the caller to skip."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : k + count]
    return mixed(out)
