"""Prefix trie of conversations by vertical bitmaps.

1. Turns become digests of role and text, so no text is shuffled. Conversations are dealt out by what they
   are rebuilt from, and written as sequences of digests.
2. Sequences are ordered and dealt to ranges. A node of the trie is a run of sequences in this order, so
   only nodes on the edges between ranges lie in several of them; no turn, however common, is dealt to one task.
   Equal sequences are one class with a count; they may go on over several ranges.
3. A task cuts its range into shards of ``SHARD`` classes. A shard has a bitset of classes for each
   (position, turn). Depth first, the bitset of a node is intersected with the postings at its depth, which yields its
   children; conversations are counted by popcounts with bitsets for the binary digits of the counts, and a bitset
   of sequence lengths gives those that end at the node.
4. Nodes inside of a shard are done. Nodes on its edges ("open") give additive parts, which Spark adds up by
   prefix: a shard knows how much of its first and last sequence its neighbours share, so each node
   and each leaf is counted once.

Ids of conversations that end at a node are hashed in order as they stream by; a class that goes on over ranges
is passed on in chunks of bytes and hashed by one task in a stream. Turns are told apart by 128-bit digests.

Defined cases: turns are ordered by turn (null first), equal ones by the digest of role and text; null role or
text is empty; rows with a null conversation id are left out; repeated rows are turns of their own; a base
conversation that is absent gives no turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelens.llm.tables import stored

#: Classes of a shard, turns after which it ends anyway, and bytes of ids passed on together.
SHARD, TURNS, CHUNK = 4096, 1 << 18, 1 << 16
#: Turns taken from the base conversation are fewer than HEADS; ids are grouped by BASE.
HEADS, BASE = 6, 100
WIDTH = 16  # bytes of a digest
NO_IDS = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "conv_id long, sequence binary, lengths array<long>"
_NODE = (
    "key binary, parent binary, first boolean, last boolean, open boolean, conv_id long, parent_conv_id long, depth long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids binary"
)


# --- sequences of turns ----------------------------------------------------------------------


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences from turns sorted by base, base conversation first, conversation, turn."""
    base: int | None = None
    heads: list[tuple[bytes, int]] = []
    own: list[tuple[bytes, int]] = []
    current: int | None = None
    done: list[tuple[int, bytes, list[int]]] = []
    size = 0

    def end() -> None:
        nonlocal heads, own, size
        if current is None:
            return
        if current == base:
            heads = own[: HEADS - 1]
        taken = zlib.crc32(str(current).encode()) % HEADS
        turns = heads[:taken] + own[taken:]
        done.append((current, b"".join(x for x, _ in turns), [n for _, n in turns]))
        size += len(turns)
        own = []

    def batch_of() -> pa.RecordBatch:
        ids, sequences, lengths = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sequences, pa.binary()), pa.array(lengths, pa.list_(pa.int64()))], ["conv_id", "sequence", "lengths"]
        )

    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("base", "conv_id", "digest", "n_chars"))
        for new_base, conv, digest, chars in zip(*columns, strict=True):
            if conv != current:
                end()
                if new_base != base:
                    base, heads = new_base, []
                current = conv
            own.append((digest, chars))
        if size >= TURNS:
            yield batch_of()
            done, size = [], 0
    end()
    if done:
        yield batch_of()


def rebuilt(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation's ``sequence`` (digests of its rebuilt turns, ``WIDTH`` bytes each) and their ``lengths`` in code points."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        (F.col(conv_id) - F.col(conv_id) % BASE).cast("long").alias("base"),
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))).alias("digest"),
        F.char_length(text_).cast("long").alias("n_chars"),
    )
    own_first = (F.col("conv_id") != F.col("base")).alias("other")
    ordered = rows.repartition(_parts(rows), "base").sortWithinPartitions("base", own_first, "conv_id", F.asc_nulls_first("turn"), "digest")
    return ordered.select("base", "conv_id", "digest", "n_chars").mapInArrow(_rebuilt, _SEQUENCE)


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


# --- shards ----------------------------------------------------------------------------------


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences begin with alike; -1 if one is missing."""
    if a is None or b is None:
        return -1
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    low, high = 0, most - 1  # equal up to low, not beyond high
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Class:
    """Equal sequences: how many, their smallest id, and the hash of their ids where it is known."""

    sequence: bytes
    lengths: list[int]
    count: int
    least: int
    ends: str | None

    @property
    def depth(self) -> int:
        return len(self.sequence) // WIDTH

    def turn(self, position: int) -> bytes:
        return self.sequence[position * WIDTH : (position + 1) * WIDTH]


@dataclass
class _Node:
    """A node on the way down and what its subtree has given so far."""

    depth: int
    members: int
    left: int  # members whose child is yet to be visited
    first: bool  # also a node of the shard before
    last: bool  # also a node of the shard after
    count: int
    least: int | None = None
    ends: str | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    rows: list[tuple] = field(default_factory=list)  # of its children, which wait for its id


class Shard:
    """Postings of (position, turn) over some neighbouring classes, as bitsets of Python's integers."""

    def __init__(self, classes: list[Class], before: int, after: int):
        self.classes, self.before, self.after = classes, before, after
        members: dict[tuple[int, bytes], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        digits: dict[int, list[int]] = {}
        for k, own in enumerate(classes):
            for position in range(own.depth):
                members.setdefault((position, own.turn(position)), []).append(k)
            lengths.setdefault(own.depth, []).append(k)
            for digit in range(own.count.bit_length()):
                if own.count >> digit & 1:
                    digits.setdefault(digit, []).append(k)
        self.postings = {at: _bitset(ks) for at, ks in members.items()}
        self.lengths = {depth: _bitset(ks) for depth, ks in lengths.items()}
        self.digits = {digit: _bitset(ks) for digit, ks in digits.items()}
        self.top = 1 << (len(classes) - 1)

    def conversations(self, members: int) -> int:
        return sum((members & bits).bit_count() << digit for digit, bits in self.digits.items())

    def _entered(self, depth: int, members: int) -> _Node:
        ends = members & self.lengths.get(depth, 0)
        first, last = bool(members & 1) and depth <= self.before, bool(members & self.top) and depth <= self.after
        node = _Node(depth, members, members & ~ends, first, last, self.conversations(members))
        if ends:
            own = self.classes[_lowest(ends)]
            node.least, node.ends = own.least, own.ends
        return node

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_NODE``: a child of an open node has its parent's key, one of a closed node its parent's id."""
        path = [self._entered(0, (1 << len(self.classes)) - 1)]
        while path:
            node = path[-1]
            example = self.classes[_lowest(node.members)]
            if node.left:
                turn = self.classes[_lowest(node.left)].turn(node.depth)
                child = self._entered(node.depth + 1, node.left & self.postings[node.depth, turn])
                node.left &= ~child.members
                node.children += not child.first  # one that the shard before has too is counted there
                path.append(child)
                continue
            path.pop()
            if node.depth:
                node.saved += (node.count - (not node.first)) * example.lengths[node.depth - 1]
            if not node.last and not node.members & ~self.lengths.get(node.depth, 0):
                node.leaves += 1
            is_open = node.first or node.last
            key = _key(example.sequence, node.depth) if is_open else None
            for row in node.rows:
                yield (row[0], key, *row[2:6], None if is_open else node.least, *row[7:])
            row = (key, None, node.first, node.last, is_open, node.least, None, node.depth, node.count, node.children, node.leaves, node.saved, node.ends, None)
            if not path:
                yield row
                return
            parent = path[-1]
            parent.rows.append(row)
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.least = node.least if parent.least is None else min(parent.least, node.least)


def _key(sequence: bytes, depth: int) -> bytes:
    return hashlib.md5(sequence[: depth * WIDTH], usedforsecurity=False).digest()


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bitset(numbers: list[int]) -> int:
    marks = np.zeros(numbers[-1] + 1, np.uint8)
    marks[numbers] = 1
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


# --- ranges ----------------------------------------------------------------------------------


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, number, raw, flag = pa.string(), pa.int64(), pa.binary(), pa.bool_()
    kinds = (raw, raw, flag, flag, flag, number, number, number, number, number, number, number, text, raw)
    names = [part.split()[0] for part in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _range_nodes(edges: dict[int, tuple[bytes | None, bytes | None]], shard_classes: int = SHARD, chunk_size: int = CHUNK):
    """Nodes of ranges sorted by sequence and id; ``edges``: the sequences beside each range."""

    def range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        part: int | None = None
        before: bytes | None = None  # sequence of the class before the shard
        classes: list[Class] = []
        turns = 0
        own: Class | None = None
        hashed = hashlib.sha256()
        chunk: list[str] = []
        chunk_least = chunk_bytes = 0
        cut = False  # the current class goes on in another range

        def end_chunk() -> None:
            nonlocal chunk, chunk_bytes
            if chunk:
                none = (None,) * 6
                rows.append((_key(own.sequence, own.depth), None, False, False, True, chunk_least, *none, None, ",".join(chunk).encode()))
            chunk, chunk_bytes = [], 0

        def end_class() -> None:
            nonlocal own, turns
            if own is None:
                return
            if cut:
                end_chunk()
            else:
                own.ends = hashed.hexdigest()
            classes.append(own)
            turns += own.depth + 1
            own = None

        def end_shard(after: bytes | None) -> None:
            nonlocal classes, turns, before
            if classes:
                shard = Shard(classes, shared_turns(before, classes[0].sequence), shared_turns(classes[-1].sequence, after))
                rows.extend(shard.nodes())
                before = classes[-1].sequence
            classes, turns = [], 0

        def end_part() -> None:
            end_class()
            if part is not None:
                end_shard(edges[part][1])

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("part", "sequence", "conv_id", "lengths"))
            for new_part, sequence, conv, lengths in zip(*columns, strict=True):
                if new_part != part:
                    end_part()
                    part, before = new_part, edges[new_part][0]
                if own is None or sequence != own.sequence:
                    end_class()
                    if len(classes) >= shard_classes or turns >= TURNS:
                        end_shard(sequence)
                    own, hashed = Class(sequence, lengths, 0, conv, None), hashlib.sha256()
                    cut = sequence in edges[part]
                name = str(conv)
                if cut:
                    if not chunk:
                        chunk_least = conv
                    chunk.append(name)
                    chunk_bytes += len(name) + 1
                    if chunk_bytes >= chunk_size:
                        end_chunk()
                else:
                    hashed.update((("," if own.count else "") + name).encode())
                own.count += 1
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        end_part()
        if rows:
            yield _batch(rows)

    return range_nodes


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each class's ids, from chunks sorted by class and first id."""
    key: bytes | None = None
    hashed = hashlib.sha256()
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for new_key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if new_key != key:
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed = new_key, hashlib.sha256(ids)
            else:
                hashed.update(b"," + ids)
    if key is not None:
        done.append((key, hashed.hexdigest()))
    keys, ends = zip(*done, strict=True) if done else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "cut_ends"])


def prefix_trie(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    sequences = rebuilt(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    count = _parts(sequences)
    ranged = stored(stored(sequences).repartitionByRange(count, "sequence", "conv_id").withColumn("part", F.spark_partition_id()))
    # one row for each range
    ends = ranged.groupBy("part").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).orderBy("part").collect()
    low, high = [bytes(row["low"]) for row in ends], [bytes(row["high"]) for row in ends]
    edges = {row["part"]: (high[k - 1] if k else None, low[k + 1] if k + 1 < len(low) else None) for k, row in enumerate(ends)}
    ordered = ranged.repartition(count, "part").sortWithinPartitions("part", "sequence", "conv_id")
    nodes = stored(ordered.select("part", "sequence", "conv_id", "lengths").mapInArrow(_range_nodes(edges), _NODE))

    chunks = nodes.where("ids is not null").select("key", "conv_id", "ids").repartition(count, "key").sortWithinPartitions("key", "conv_id")
    cut_ends = chunks.select("key", "ids").mapInArrow(_joined_ids, "key binary, cut_ends string")
    parts = nodes.where("open and ids is null")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        *[F.sum(name).cast("long").alias(name) for name in sums],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = stored(merged.join(cut_ends, "key", "left").withColumn("ends_sha256", F.coalesce("cut_ends", "ends_sha256")).drop("cut_ends"))
    ids = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("merged_conv_id"))
    rows = nodes.where("not open").select("parent", "conv_id", "parent_conv_id", "depth", *sums, "ends_sha256")
    inner = rows.where("parent is null")
    below = rows.where("parent is not null").union(merged.where("depth > 0").select("parent", "conv_id", F.lit(None).cast("long"), "depth", *sums, "ends_sha256"))
    below = below.join(ids, "parent").withColumn("parent_conv_id", F.col("merged_conv_id")).drop("merged_conv_id")
    root = merged.where("depth = 0").select("parent", "conv_id", F.lit(None).cast("long"), "depth", *sums, "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", *sums, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")]
    return inner.unionByName(below).union(root).select(*columns)
