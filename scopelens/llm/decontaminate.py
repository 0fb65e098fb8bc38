"""Benchmark decontamination: test n-grams in a broadcast hash set, training windows looked up in it.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z in lower case. A window is
``size`` consecutive words of an item; an item with fewer words, but not none, is one window. Word
windows of a document are looked up by hash and verified by their bytes.

Defined cases: null and empty texts have no words and no hits; rows repeat as they come; an empty
benchmark hits nothing; items with equal windows are all reported; items with a null id or text are
left out; other columns of the documents are kept, ones named ``n_words``, ``spans`` or ``items`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.blocks import Hashes, blocks, lower_ascii, rows_of, runs, windows
from scopelens.llm.memory import tidy
from scopelens.llm.tables import free_name, stored

#: Bytes of benchmark text in one broadcast set; a larger benchmark is looked up in several sets, one after another.
SET_BYTES = 4 << 20

RESULT = "struct<n_words: bigint, spans: array<struct<first: bigint, last: bigint, from: bigint, to: bigint>>, items: array<bigint>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])
_RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.int64()))])

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    data = lower_ascii(data)
    starts, ends = runs(_WORD[data], offsets)
    return data, starts, ends, Hashes(data).of(starts, ends)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True))


class TestWindows:
    """The windows of some benchmark items: sorted hashes per window size, and the words of each."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.items: dict[bytes, set[int]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            data, starts, ends, hashes = _words(raw, np.array([0, len(raw)]))
            length = min(size, len(starts))
            if not length:
                continue
            found.setdefault(length, []).append(windows(hashes, length))
            for k in range(len(starts) - length + 1):
                self.items.setdefault(_joined(data, starts[k : k + length], ends[k : k + length]), set()).add(item_id)
        self.hashes = {length: np.unique(np.concatenate(x)) for length, x in found.items()}

    def scan(self, column: pa.Array) -> pa.Array:
        out = []
        for block in blocks(column):
            data, starts, ends, hashes = _words(block.data, block.offsets)
            rows, bounds = rows_of(starts, block.offsets)
            hits: dict[int, list[tuple[int, int, set[int]]]] = {}
            for length, known in self.hashes.items():
                window = windows(hashes, length)
                place = np.minimum(np.searchsorted(known, window), len(known) - 1)
                same = (known[place] == window) & (rows[: len(window)] == rows[length - 1 :][: len(window)])
                for k in np.flatnonzero(same).tolist():
                    items = self.items.get(_joined(data, starts[k : k + length], ends[k : k + length]))
                    if items:
                        hits.setdefault(int(rows[k]), []).append((k, k + length, items))
            for row in range(len(block)):
                spans: list[list[int]] = []
                items: set[int] = set()
                for first, last, ids in sorted(hits.get(row, []), key=lambda hit: hit[:2]):
                    items |= ids
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last)
                    else:
                        spans.append([first, last])
                base, start = int(bounds[row]), int(block.offsets[row])
                out.append(
                    {
                        "n_words": int(bounds[row + 1]) - base,
                        "spans": [
                            {"first": a - base, "last": b - base, "from": int(starts[a]) - start, "to": int(ends[b - 1]) - start}
                            for a, b in spans
                        ],
                        "items": sorted(items),
                    }
                )
        return pa.array(out, _RESULT)


def _sets(benchmark: DataFrame, item_id: str, text: str, size: int, set_bytes: int) -> Iterator[TestWindows]:
    """The benchmark, which is a stated query set, block by block; one block at a time is on the driver.

    Blocks are made so that their expected size is ``set_bytes``; one with twice as much is cut again.
    """
    items = stored(benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).dropna().distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    waiting = [(k, max(1, -(-total // set_bytes))) for k in range(max(1, -(-total // set_bytes)))]
    while waiting:
        part, parts = waiting.pop()
        own = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(parts)) == part)
        held = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        if held["n"] > 1 and held["bytes"] > 2 * set_bytes:
            waiting += [(part, 2 * parts), (part + parts, 2 * parts)]
        elif held["n"] or parts == 1:
            yield TestWindows([tuple(row) for row in own.collect()], size)


def _scanner(known: TestWindows):
    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda texts: map(known.scan, texts))(batches)

    return scan


def find(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, set_bytes: int = SET_BYTES
) -> DataFrame:
    """The documents with ``n_words``, ``spans`` (word numbers and bytes, end excluded) and ``items``."""
    own = free_name(documents, "found")
    found, mark = _found(documents, own, _sets(benchmark, item_id, item_text, size, set_bytes), text, size)
    return found.select(
        *[F.col(f"`{name}`") for name in documents.columns if name not in ("n_words", "spans", "items")],
        mark["n_words"].alias("n_words"),
        mark["spans"].alias("spans"),
        mark["items"].alias("items"),
    )


def _found(documents: DataFrame, own: str, sets: Iterator[TestWindows], text: str, size: int) -> tuple[DataFrame, Column]:
    """The documents with a column ``own`` and what was found in them.

    Of several sets one at a time is scanned for; its hits are written, and put together by row at the end.
    """
    first = next(sets, None) or TestWindows([], size)
    second = next(sets, None)
    if second is None:
        scanned = documents.withColumn(own, _scanner(first)(F.col(text)))
        return scanned, F.col(own)
    number, hit = free_name(documents, "row_number"), free_name(documents, "hit")
    rows = stored(documents.withColumn(number, F.monotonically_increasing_id()))
    hits = None
    for known in chain((first, second), sets):
        one = rows.select(number, _scanner(known)(F.col(text)).alias("found")).where(F.size("found.spans") > 0)
        one = stored(one.select(number, "found.spans", "found.items"))
        hits = one if hits is None else hits.union(one)
    joined = hits.groupBy(number).agg(
        merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    words = _scanner(TestWindows([], size))(F.col(text))["n_words"]
    none = F.array().cast(dict(joined.dtypes)["spans"]), F.array().cast("array<bigint>")
    whole = F.struct(
        words.alias("n_words"), F.coalesce(F.col(f"{hit}.spans"), none[0]).alias("spans"), F.coalesce(F.col(f"{hit}.items"), none[1]).alias("items")
    )
    packed = joined.select(number, F.struct("spans", "items").alias(hit))
    return rows.join(packed, number, "left").withColumn(own, whole).drop(number), F.col(own)


def clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, set_bytes: int = SET_BYTES) -> DataFrame:
    """The documents in which no window occurs, all columns as they are."""
    own = free_name(documents, "found")
    found, mark = _found(documents, own, _sets(benchmark, item_id, item_text, size, set_bytes), text, size)
    return found.where(F.size(mark["spans"]) == 0).select(*[F.col(f"`{name}`") for name in documents.columns])


def merged(spans: Column) -> Column:
    """Spans in order, those that touch or overlap joined."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"),
            F.greatest(last["last"], span["last"]).alias("last"),
            last["from"].alias("from"),
            F.greatest(last["to"], span["to"]).alias("to"),
        )
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (span["first"] <= last["last"]), F.concat(kept, F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    kind = "array<struct<first: bigint, last: bigint, from: bigint, to: bigint>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select(
        doc_id,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
