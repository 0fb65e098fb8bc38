"""Suffix-array deduplication of byte passages that repeat within and across texts.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller id, or in
the same text before. Strings are judged on the whole input; the first occurrence stays.

Sorting the suffixes of a whole corpus in one place is what must not happen, so the corpus is cut into
pieces that can be sorted apart and lose no match:

1. Every string of ``length`` bytes has an anchor, its ``ANCHOR``-byte part with the least hash. Strings
   next to each other that have the same anchor form a stretch. Equal strings have equal anchors at
   equal distance, so stretches are dealt out by anchor. Stretches with equal bytes are all repeats but
   the first; a task settles those within a block of texts before anything is shuffled.
2. First stretches of equal anchor that also agree on the middle part which all strings in a quarter of
   the anchor's range share are cut to the pieces of that quarter; 15 bits of the middle's hash sort
   out most that do not agree. A piece's key is then made from the whole hash of the middle, some 80
   bytes, so that all pieces of a key have it in common. It is written as the key's number in
   ``DIGITS`` bytes, which leaves some 40 bytes. A piece that shares its key with no other holds no repeat; of
   pieces with equal bytes the others than the first are repeats.
3. The pieces dealt to a task form a collection whose Burrows-Wheeler transform and common prefixes are
   built column by column in sequential files (``column_bwt``). Suffixes that share ``length`` bytes
   with their predecessor are one string; all its occurrences but the first are repeats.

Anchor and bytes of a stretch, and the middle of a piece, are compared by 64-bit hashes each; the
bytes of a piece around its middle are compared themselves.

Defined cases: null texts are empty; rows with a null id are left out; repeated rows (equal id and
text) are one document and get equal results; rows of equal id and different texts are ordered by a
hash of their texts; other columns are kept, ones named ``n_bytes``, ``spans`` or
``kept_bytes`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.blocks import Block, Hashes, blocks, mixed
from scopelens.llm.column_bwt import sorted_suffixes
from scopelens.llm.memory import tidy
from scopelens.llm.tables import free_name, stored

ANCHOR, QUARTERS = 28, 4
#: Pieces of a collection, which ends with the first key that begins after so many; bytes of a key's number.
COLLECTION, DIGITS = 60_000, 4
_STRETCHES = "anchor long, same long, parts long, id long, place long, count int, settled boolean"
_FOUND = "id long, text_hash int, start long, count int, key long, quarter int, before int"
_PIECE = ["key", "id", "text_hash", "start", "count", "before", "after"]


# A stretch's place holds the text's hash, the first string's start and the anchor's distance from it,
# so that places of one id are in order.
_HASH_SHIFT, _START_SHIFT = 48, 8


def _text_hash(block: Block, hashes: Hashes) -> np.ndarray:
    return (hashes.of(block.offsets[:-1], block.offsets[1:]) >> np.uint64(50)).astype(np.int64)  # 14 bits


def _ranges(length: int) -> list[tuple[int, int]]:
    """First and last start, relative to the anchor, of each quarter; all of one width."""
    width = -(-(length - ANCHOR + 1) // QUARTERS)
    return [(1 - width * (k + 1), -width * k) for k in range(QUARTERS)]


def _stretches(block: Block, hashes: Hashes, length: int):
    """Row, first start, anchor and count of the stretches of a block."""
    size = len(block.data)
    lengths = np.diff(block.offsets)
    if size < length:
        return None
    starts = np.arange(size - ANCHOR + 1)
    codes = hashes.of(starts, starts + ANCHOR)
    bits = max(21, size.bit_length())
    least = ((codes >> np.uint64(bits)) << np.uint64(bits)) | starts.astype(np.uint64)
    width, spread = length - ANCHOR + 1, 1
    while 2 * spread <= width:
        least = np.minimum(least[:-spread], least[spread:])
        spread *= 2
    least = np.minimum(least[: len(least) - (width - spread)], least[width - spread :])
    anchors = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    counts = np.maximum(lengths - length + 1, 0)
    if not counts.sum():
        return None
    rows = np.repeat(np.arange(len(lengths)), counts)
    firsts = np.cumsum(counts) - counts
    start = np.arange(len(rows)) - firsts[rows] + block.offsets[rows]
    anchor = anchors[start]
    new = np.ones(len(rows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], start[at], anchor[at], np.diff(np.append(at, len(rows))), codes[anchor[at]]


def _firsts(changes: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted within groups, which begin after ``changes``: the first of each, and those elsewhere than the first."""
    first = np.append(True, changes)[: len(ids)]
    at = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return first, (ids != ids[at]) | (place != place[at])


def _cut(length: int):
    ranges = _ranges(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for block in blocks(batch.column("text")):
                hashes = Hashes(block.data)
                found = _stretches(block, hashes, length)
                if found is None:
                    continue
                rows, start, anchor, count, code = found
                distance = (anchor - start).astype(np.uint64)
                same = mixed(hashes.of(start, start + count - 1 + length) + distance * np.uint64(0x9E3779B97F4A7C15))
                parts = np.zeros(len(rows), np.uint64)
                for k, (low, high) in enumerate(ranges):
                    # all strings that start in [low, high] hold the bytes from high to low + length
                    held = np.flatnonzero((start - anchor <= high) & (start + count - 1 - anchor >= low))
                    part = hashes.of(anchor[held] + high, anchor[held] + low + length)
                    parts[held] |= ((part >> np.uint64(48)) | np.uint64(1)) << np.uint64(16 * k)  # 0: none
                place = (_text_hash(block, hashes)[rows] << _HASH_SHIFT) | ((start - block.offsets[rows]) << _START_SHIFT) | (anchor - start)
                own = ids[block.first + rows]
                order = np.lexsort((place, own, same))
                first, repeated = _firsts(same[order[1:]] != same[order[:-1]], own[order], place[order])
                settled = np.zeros(len(rows), bool)
                settled[order[repeated]] = True
                code = np.where(settled, mixed(own.astype(np.uint64)), code)
                sent = order[first | repeated]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[sent]) for x in (code.view(np.int64), same.view(np.int64), parts.view(np.int64), own, place, count.astype(np.int32), settled)],
                    ["anchor", "same", "parts", "id", "place", "count", "settled"],
                )

    return cut


def _split(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text hash, start and the anchor's distance."""
    start = (place >> _START_SHIFT) & ((1 << (_HASH_SHIFT - _START_SHIFT)) - 1)
    return (place >> _HASH_SHIFT).astype(np.int32), start, place & ((1 << _START_SHIFT) - 1)


def _found(ids, place, start, count, key=None, quarter=None, before=None) -> pa.RecordBatch:
    """Repeated strings (no key), or pieces to compare."""
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            pa.array(_split(place)[0]),
            pa.array(start),
            pa.array(count.astype(np.int32)),
            none if key is None else pa.array(key),
            none.cast(pa.int32()) if quarter is None else pa.array(np.full(len(ids), quarter, np.int32)),
            none.cast(pa.int32()) if before is None else pa.array(before.astype(np.int32)),
        ],
        ["id", "text_hash", "start", "count", "key", "quarter", "before"],
    )


def _settle(length: int):
    """Stretches sorted by anchor, bytes and place: repeats, and pieces of first stretches that may share strings."""
    ranges = _ranges(length)

    def of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, same, parts, ids, place, count, settled = rows
        changes = (same[1:] != same[:-1]) | (anchor[1:] != anchor[:-1]) | (settled[1:] != settled[:-1])
        first, repeated = _firsts(changes, ids, place)
        done = repeated | settled
        if done.any():
            yield _found(ids[done], place[done], _split(place[done])[1], count[done])
        left = np.flatnonzero(first & ~settled)
        group = np.cumsum(np.append(True, anchor[left][1:] != anchor[left][:-1])) if len(left) else left
        shared = np.bincount(group, minlength=1)[group] > 1 if len(left) else np.zeros(0, bool)
        left = left[shared]
        for k, (low, high) in enumerate(ranges):
            part = (parts[left].view(np.uint64) >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            mine = left[part > 0]
            key = mixed(mixed(anchor[mine].view(np.uint64)) + (part[part > 0] << np.uint64(8)) + np.uint64(k)).view(np.int64)
            _, which, members = np.unique(key, return_inverse=True, return_counts=True)
            several = members[which] > 1
            mine, key = mine[several], key[several]
            if len(mine):
                _, start, distance = _split(place[mine])
                first = np.maximum(start, start + distance + low)
                last = np.minimum(start + count[mine] - 1, start + distance + high)
                yield _found(ids[mine], place[mine], first, last - first + 1, key, k, start + distance + high - first)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(column) for column in batch.columns[:6]] + [batch.column(6).to_numpy(zero_copy_only=False)]
            if kept is not None:
                rows = [np.concatenate(pair) for pair in zip(kept, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            kept = [column[last:] for column in rows]
            if last:
                yield from of([column[:last] for column in rows])
        if kept is not None:
            yield from of(kept)

    return settle


def _pieces(length: int):
    """The bytes of each piece before and after its middle, from rows of a text with its pieces; the key tells middles apart."""
    middles = [length + low - high for low, high in _ranges(length)]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                bytes_hashes = Hashes(block.data)
                hashes = _text_hash(block, bytes_hashes)
                out: list[tuple] = []
                held: list[tuple[int, int]] = []  # the middles in the block
                for row in range(len(block)):
                    text = block.text(row)
                    doc = batch.column("id")[block.first + row].as_py()
                    for piece in batch.column("pieces")[block.first + row].as_py():
                        if piece["text_hash"] == hashes[row]:
                            start, middle = piece["start"], piece["start"] + piece["before"]
                            end = middle + middles[piece["quarter"]]
                            after = text[end : start + piece["count"] - 1 + length]
                            held.append((int(block.offsets[row]) + middle, int(block.offsets[row]) + end))
                            out.append((piece["key"], doc, piece["text_hash"], start, piece["count"], text[start:middle], after))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    key = np.asarray(columns[0]).view(np.uint64) + bytes_hashes.of(*np.array(held).T)
                    columns[0] = pa.array(mixed(key).view(np.int64))
                    yield pa.RecordBatch.from_arrays(columns, _PIECE)

    return pieces


def _repeated(ids, text_hash, start, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(text_hash), pa.array(start), pa.array(count)], ["id", "text_hash", "start", "count"])


def _compare(length: int):
    """Repeated strings among the pieces of a partition, in collections of bounded size."""
    wanted = -(-(length - ANCHOR + 1) // QUARTERS) - 1 + DIGITS  # symbols of a string

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        key = np.asarray(table.column("key"))
        number = np.cumsum(np.append(0, key[1:] != key[:-1]))
        shared = np.bincount(number)[number] > 1  # a string is repeated in two pieces of one key, or not at all
        table, number = table.filter(pa.array(shared)), number[shared]
        if not len(number):
            return
        ids, text_hash, start, count = (np.asarray(table.column(c)) for c in ("id", "text_hash", "start", "count"))
        before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
        # of pieces with equal bytes the others than the first are repeats as they are
        order = np.lexsort((start, text_hash, ids, number)).tolist()
        seen: dict[tuple, int] = {}
        copy = np.zeros(len(number), bool)
        for k, kind in zip(order, number[order].tolist(), strict=True):
            copy[k] = seen.setdefault((kind, before[k], after[k]), k) != k
        if copy.any():
            yield _repeated(ids[copy], text_hash[copy], start[copy], count[copy])
        left = np.flatnonzero(~copy)
        left = left[np.bincount(number[left])[number[left]] > 1]
        ids, text_hash, start, number = ids[left], text_hash[left], start[left], number[left]
        strings = [before[k] + int(kind).to_bytes(DIGITS, "big") + after[k] for k, kind in zip(left.tolist(), number.tolist(), strict=True)]
        ahead = np.array([len(before[k]) for k in left.tolist()], np.int64)
        repeats: list[np.ndarray] = []
        for who, begin, common in sorted_suffixes(strings):
            same = common >= wanted
            same[:1] = False
            inside = same.copy()
            inside[:-1] |= same[1:]  # with the first of each string
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            string = np.cumsum(~same[at])
            who, begin = who[at].astype(np.int64), begin[at].astype(np.int64)
            # equal symbols are equal strings if they hold the number of the same key at the same place
            kind, offset = number[who], ahead[who] - begin
            order = np.lexsort((start[who] + begin, text_hash[who], ids[who], offset, kind, string))
            changes = np.zeros(len(order) - 1, bool)
            for column in (string[order], kind[order], offset[order]):
                changes |= column[1:] != column[:-1]
            own = who[order]
            place = (text_hash[own].astype(np.int64) << _HASH_SHIFT) + start[own] + begin[order]
            later = order[_firsts(changes, ids[own], place)[1]]
            repeats.append(np.stack([who[later], start[who[later]] + begin[later]]))
        if repeats:
            who, place = np.concatenate(repeats, axis=1)
            order = np.lexsort((place, who))
            who, place = who[order], place[order]
            new = np.append(True, (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1))
            at = np.flatnonzero(new)
            yield _repeated(ids[who[at]], text_hash[who[at]], place[at], np.diff(np.append(at, len(who))).astype(np.int32))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("key"))
            if size >= COLLECTION and (cut := int(np.searchsorted(keys, held[-1].column("key")[-1].as_py(), "right"))) < len(keys):
                if cut:
                    held.append(batch.slice(0, cut))
                yield from of(held)
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from of(held)

    return compare


def _kept(length: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            out: list[tuple] = []
            texts, found = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for block in blocks(texts):
                hashes = _text_hash(block, Hashes(block.data))
                for row in range(len(block)):
                    size = int(block.offsets[row + 1] - block.offsets[row])
                    strings = found[block.first + row].as_py() or []
                    cover = np.zeros(size + 1, np.int64)
                    for string in strings:
                        if string["text_hash"] == hashes[row]:
                            cover[string["start"]] += 1
                            cover[string["start"] + string["count"] - 1 + length] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = [{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    data = block.data[block.offsets[row] : block.offsets[row + 1]]
                    out.append((size, spans, data[~gone].tobytes()))
            columns = zip(*out, strict=True) if out else ([], [], [])
            sizes, spans, rest = columns
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 2)), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary())],
                [*batch.schema.names[:-2], "n_bytes", "spans", "kept_bytes"],
            )

    return kept


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def without_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """The documents but for their text, with ``n_bytes``, ``spans`` (removed bytes, end excluded) and ``kept_bytes``."""
    present = documents.where(F.col(doc_id).isNotNull())
    texts = present.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    stretches = texts.where(F.octet_length("text") >= length).mapInArrow(tidy(_cut(length)), _STRETCHES)
    dealt = stretches.repartition(_parts(stretches), "anchor").sortWithinPartitions("anchor", "same", "settled", "id", "place")
    found = stored(dealt.mapInArrow(tidy(_settle(length)), _FOUND))
    wanted = found.where("key is not null").groupBy("id").agg(F.collect_list(F.struct("key", "quarter", "text_hash", "start", "count", "before")).alias("pieces"))
    pieces = texts.join(wanted, "id").mapInArrow(tidy(_pieces(length)), "key long, id long, text_hash int, start long, count int, before binary, after binary")
    pieces = pieces.repartition(_parts(pieces), "key").sortWithinPartitions("key")
    compared = pieces.mapInArrow(tidy(_compare(length)), "id long, text_hash int, start long, count int")
    repeats = stored(found.where("key is null").select("id", "text_hash", "start", "count").union(compared))
    strings = repeats.groupBy("id").agg(F.collect_list(F.struct("text_hash", "start", "count")).alias("strings"))
    others = [name for name in documents.columns if name != text and name not in ("n_bytes", "spans", "kept_bytes")]
    # columns of this step have names of their own, so any columns can come along
    own_id, own_text, own_strings = (free_name(documents, name) for name in ("own_id", "own_text", "own_strings"))
    own = present.select(*[F.col(f"`{name}`") for name in others], F.col(doc_id).cast("long").alias(own_id), F.col(text).alias(own_text))
    joined = own.join(strings.withColumnsRenamed({"id": own_id, "strings": own_strings}), own_id, "left").select(*[F.col(f"`{name}`") for name in others], own_text, own_strings)
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in joined.schema.fields[:-2])
    return joined.mapInArrow(tidy(_kept(length)), f"{kinds}, n_bytes long, spans array<struct<from: long, to: long>>, kept_bytes binary")


def whole_characters(kept: str = "kept_bytes") -> Column:
    """Kept bytes as text; a character that a cut left in part is dropped."""

    @F.arrow_udf("string")
    def decoded(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in values.to_pylist()], pa.string())

    return decoded(F.col(kept))


def digest(kept: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return kept.select(
        doc_id,
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["to"] - s["from"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
