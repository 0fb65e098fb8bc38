"""Burrows-Wheeler transform and common prefixes of many short strings, built column by column.

Every round inserts one symbol of each string, from its end to its start: the suffix that grew by this
symbol is placed by counting the symbol before the shorter suffix, and the common prefixes beside it
follow from minima between neighbouring occurrences. The collection lies in one file, in which suffixes with the
same first symbol ("piles") follow each other. A round reads the file once from start to end and writes the
next one; a pile that has just received its suffixes also tells where these grow to in the next round, so
no pile is read twice. One pile is in memory at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

END = 0  # the symbol before a string's start; bytes are symbols 1 to 256

_ROW = np.dtype([("bwt", np.uint16), ("lcp", np.uint16), ("who", np.int32), ("start", np.uint16)])
_SYMBOLS = 258


def _rows(bwt, lcp, who, start) -> np.ndarray:
    rows = np.empty(len(who), _ROW)
    rows["bwt"], rows["lcp"], rows["who"], rows["start"] = bwt, lcp, who, start
    return rows


def _range_minima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minima over [start, end), none empty."""
    if not len(starts):
        return np.empty(0, np.int64)
    padded = np.append(values, values.dtype.type(0))
    return np.minimum.reduceat(padded, np.stack([starts, ends], 1).ravel())[::2].astype(np.int64)


def sorted_suffixes(strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Suffixes in order, pile by pile: string number, start, and prefix shared with the suffix before it.

    Piles of single first symbols come in order; suffixes of different piles share nothing.
    """
    count = len(strings)
    lengths = np.array([len(x) for x in strings], np.int64)
    firsts = np.cumsum(np.append(0, lengths))[:-1]
    symbols = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1

    def before(who: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(who), np.int64)
        inner = start > 0
        out[inner] = symbols[firsts[who[inner]] + start[inner] - 1]
        return out

    everyone, zero = np.arange(count), np.zeros(count, np.int64)
    symbol, start = before(everyone, lengths), lengths.copy()
    empty = _rows(symbol, zero, everyone, lengths)  # the empty suffixes, which come first and stay
    ended = np.bincount(empty["bwt"], minlength=_SYMBOLS)
    live = np.flatnonzero(symbol != END)
    rank, above, below = (np.zeros(count, np.int64) for _ in range(3))
    rank[live], above[live], below[live] = _grown(empty, live, symbol[live], np.zeros(_SYMBOLS, np.int64))
    sizes: dict[int, int] = {}  # suffixes of each pile, in the order of the file
    with tempfile.TemporaryDirectory(prefix="piles-") as folder:
        file = Path(folder) / "0"
        file.touch()
        for turn in range(1, int(lengths.max(initial=0)) + 1):
            live = live[np.lexsort((rank[live], symbol[live]))]
            cuts = np.searchsorted(symbol[live], np.arange(_SYMBOLS + 1))
            seen, grown_sizes, following = ended.copy(), {}, Path(folder) / str(turn)
            with file.open("rb") as source, following.open("wb") as target:
                for s in sorted(sizes.keys() | set(np.unique(symbol[live]).tolist())):
                    rows, who = np.fromfile(source, _ROW, sizes.get(s, 0)), live[cuts[s] : cuts[s + 1]]
                    if len(who):
                        start[who] -= 1
                        symbol[who] = before(who, start[who])
                        new = rank[who]
                        rows = _inserted(rows, new, _rows(symbol[who], above[who], who, start[who]), below[who])
                        on = symbol[who] != END
                        rank[who[on]], above[who[on]], below[who[on]] = _grown(rows, new[on], symbol[who[on]], seen)
                    rows.tofile(target)
                    grown_sizes[s] = len(rows)
                    seen += np.bincount(rows["bwt"], minlength=_SYMBOLS)
            file.unlink()
            file, sizes = following, grown_sizes
            live = live[symbol[live] != END]
        with file.open("rb") as source:
            for size in sizes.values():
                rows = np.fromfile(source, _ROW, size)
                yield rows["who"], rows["start"], rows["lcp"]


def _inserted(rows: np.ndarray, places: np.ndarray, new: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A pile with new suffixes at their places, and the prefix that each shares with the one after it."""
    out = np.empty(len(rows) + len(new), _ROW)
    old = np.ones(len(out), bool)
    old[places] = False
    out[old], out[places] = rows, new
    inner = places + 1 < len(out)
    out["lcp"][places[inner] + 1] = below[inner]
    return out


def _grown(rows: np.ndarray, where: np.ndarray, own: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes of a pile that grow by the symbols ``own``: the occurrences of the symbol before them (``seen``:
    in earlier piles), and the prefixes that the grown suffix will share with those above and below it."""
    grouped = np.argsort(rows["bwt"], kind="stable")  # occurrences of each symbol, in order
    turn = np.empty(len(grouped), np.int64)
    turn[grouped] = np.arange(len(grouped))
    first = np.cumsum(np.append(0, np.bincount(rows["bwt"], minlength=_SYMBOLS)))
    at = turn[where]
    above, below = (seen[own] > 0).astype(np.int64), np.ones(len(where), np.int64)
    inner = at > first[own]
    above[inner] = 1 + _range_minima(rows["lcp"], grouped[at[inner] - 1] + 1, where[inner] + 1)
    inner = at + 1 < first[own + 1]
    below[inner] = 1 + _range_minima(rows["lcp"], where[inner] + 1, grouped[at[inner] + 1] + 1)
    return seen[own] + at - first[own], above, below
