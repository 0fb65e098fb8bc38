"""MinHash near-duplicates with odd sketches.

Texts are sets of word shingles. Equal sets form a class, kept once. MinHash samples of a class go two
ways: groups of ``ROWS`` samples are band keys, and all samples are folded into a parity bitmap (odd
sketch), where each sample flips one bit. Classes that share a band key are candidates; the population
count of the XOR of two sketches estimates how many samples differ, and candidates far from similar
fall out. What is left is verified on full sets, and links are joined to components.

Copies of one text can be thousands, all similar to each other, so pairs are never listed:

1. each class is verified against the ``PIVOTS`` closest smallest members of its bands;
2. in bands whose members are not yet one component, members outside of the largest component are
   compared with all others of the band, in cells of bounded size, which find every further link
   between components.

Two sets with similarity of exactly 0.8 share no band key with probability
(1 - 0.8**ROWS)**BANDS = 7e-7; every link between classes that share one is found, up to links inside a
component, which change nothing.

Defined cases: a text with fewer words than a shingle has, but not none, is one shingle; null texts and
texts without words have the empty set and link with nothing; rows with a null id are left out; of
rows with the same id the one whose set has the smallest hash counts, and one row is returned; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.blocks import Hashes, blocks, lower_ascii, mixed, rows_of, runs, windows
from scopelens.llm.components import components
from scopelens.llm.groups import Sets, groups
from scopelens.llm.memory import tidy
from scopelens.llm.tables import stored

ROWS, BANDS = 5, 36
SAMPLES = ROWS * BANDS
#: Bits of a sketch, and bits of an XOR beyond which a pair is no candidate: an estimate below 0.5.
SKETCH_BITS, MOST_BITS = 512, 130
#: Classes verified against at first, and members of a cell's side.
PIVOTS, SIDE = 2, 512

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_FACTORS = (mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mixed(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _sets(column: pa.Array, shingle: int) -> Iterator[list[np.ndarray]]:
    """Block by block the distinct shingle hashes of each row, sorted."""
    for block in blocks(column):
        data = lower_ascii(block.data)
        starts, ends = runs(_WORD[data], block.offsets)
        hashes = Hashes(data).of(starts, ends)
        _, bounds = rows_of(starts, block.offsets)
        whole = windows(hashes, shingle)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= shingle:
                out.append(np.unique(whole[a : b - shingle + 1]))
            else:
                out.append(windows(hashes[a:b], b - a) if b > a else hashes[:0])
        yield out


def _identity(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    one = [mixed(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in found]
    two = [mixed(x + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for x in found]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def _signed(shingle: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for found in _sets(batch.column("text"), shingle):
                sizes = np.array([len(x) for x in found])
                one, two = _identity(found)
                filled = np.flatnonzero(sizes)
                bands, sketches = _signatures([found[k] for k in filled])
                keys, bits = [None] * len(found), [None] * len(found)
                for k, row in enumerate(filled.tolist()):
                    keys[row], bits[row] = bands[k], sketches[k]
                ids = batch.column("id").slice(first, len(found))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["id", "size", "one", "two", "bands", "sketch"],
                )
                first += len(found)

    return signed


def _signatures(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of sets that are not empty."""
    if not found:
        return np.empty((0, BANDS), np.int64), np.empty((0, SKETCH_BITS // 64), np.int64)
    starts = np.cumsum([0, *(len(x) for x in found[:-1])])
    values = (np.concatenate(found) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((SAMPLES, len(found)), np.uint32)
    for k in range(SAMPLES):
        least[k] = np.minimum.reduceat(values * _FACTORS[k] + _SHIFTS[k], starts)
    bands = np.zeros((BANDS, len(found)), np.uint64)
    for k in range(ROWS):
        bands = bands * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS]
    number = np.arange(SAMPLES, dtype=np.uint64)[:, None]
    places = (mixed(least.astype(np.uint64) + (number << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((len(found), SKETCH_BITS), np.uint8)
    for k in range(SAMPLES):
        parity[np.arange(len(found)), places[k]] ^= 1
    sketches = np.packbits(parity, axis=1).view(np.int64)
    return mixed(bands).T.view(np.int64), sketches


def _differ(a: str, b: str) -> Column:
    """Bits by which two sketches differ."""
    words = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)]
    total = words[0]
    for word in words[1:]:
        total = total + word
    return total


def _may_link(percent: int) -> Column:
    """Sizes of sets a and b allow the similarity, and so do their sketches."""
    sizes = (F.least("a_size", "b_size") * 100) >= (F.greatest("a_size", "b_size") * percent)
    return sizes & (_differ("a_sketch", "b_sketch") <= MOST_BITS)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _candidates(percent: int):
    """Members of a cell that have a candidate in another component: the rows whose sets are worth reading."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, "cell"):
            side, sizes, label = (np.asarray(cell.column(c)) for c in ("side", "size", "component"))
            bits = np.asarray(cell.column("sketch").combine_chunks().flatten()).reshape(len(side), -1)
            bands = np.asarray(cell.column("bands").combine_chunks().flatten()).reshape(len(side), -1)
            band = cell.column("band")[0].as_py()
            wanted = np.zeros(len(side), bool)
            for k in np.flatnonzero(side == 0).tolist():
                near = _near(k, bits, sizes, label, percent)
                near = near[(bands[near] == bands[k]).argmax(1) == band]  # elsewhere the pair was met before
                wanted[near] = True
                wanted[k] |= len(near) > 0
            yield from cell.filter(pa.array(wanted)).select(["cell", "side", "id", "component"]).to_batches()

    return candidates


def _near(k: int, bits: np.ndarray, sizes: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    differ = np.bitwise_count((bits ^ bits[k]).view(np.uint64)).sum(1)  # signed words would be counted by magnitude
    fits = (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k])) & (label != label[k])
    return np.flatnonzero(fits & (differ <= MOST_BITS))


def _verified(percent: int):
    """Links of a cell's first side with all its members, only those that join components."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, "cell"):
            side, ids, label = (np.asarray(cell.column(c)) for c in ("side", "id", "component"))
            found = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("shingles")]
            sizes = np.array([len(x) for x in found])
            bits = np.asarray(cell.column("sketch").combine_chunks().flatten()).reshape(len(side), -1)
            number = {x: k for k, x in enumerate(np.unique(label).tolist())}
            sets, own = Sets(len(number)), [number[x] for x in label.tolist()]
            a, b = [], []
            for k in np.flatnonzero(side == 0).tolist():
                for other in _near(k, bits, sizes, label, percent).tolist():
                    if sets.find(own[k]) != sets.find(own[other]) and _similar(found[k], found[other], percent):
                        sets.union(own[k], own[other])
                        a.append(ids[k])
                        b.append(ids[other])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verified


def _shingled(shingle: int):
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for found in _sets(batch.column("text"), shingle):
                one, two = _identity(found)
                ids = batch.column("id").slice(first, len(found))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(one), pa.array(two), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "one", "two", "shingles"]
                )
                first += len(found)

    return shingled


class _Corpus:
    def __init__(self, documents: DataFrame, doc_id: str, text: str, shingle: int, percent: int):
        self.texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
        self.shingle, self.percent = shingle, percent
        signed = self.texts.mapInArrow(tidy(_signed(shingle)), "id long, size long, one long, two long, bands array<long>, sketch array<long>"
        )
        self.signed = stored(signed)
        ids = self.signed.groupBy("id").agg(F.min(F.struct("one", "two", "size")).alias("own")).select("id", "own.*")
        self.documents = ids
        least = ids.where("size > 0").groupBy("one", "two", "size").agg(F.min("id").alias("id"))
        self.classes = stored(
            self.signed.join(least, ["id", "one", "two", "size"]).dropDuplicates(["id"])
        )

    def sets(self, ids: DataFrame) -> DataFrame:
        """The shingles and sketches of some classes."""
        wanted = self.classes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "one", "two", "sketch")
        texts = self.texts.join(wanted.select("id"), "id", "left_semi")
        found = texts.mapInArrow(tidy(_shingled(self.shingle)), "id long, one long, two long, shingles binary")
        return stored(found.join(wanted, ["id", "one", "two"]).select("id", "sketch", "shingles").dropDuplicates(["id"]))

    def links(self, cells: DataFrame) -> DataFrame:
        """Verified links within cells (cell, side, id, component)."""
        whole = cells.join(self.sets(cells), "id")
        parted = whole.repartition(_parts(whole), "cell").sortWithinPartitions("cell")
        return parted.mapInArrow(tidy(_verified(self.percent)), "a long, b long")


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _first_cells(corpus: _Corpus, members: DataFrame) -> DataFrame:
    """Each class beside the closest of the smallest ids of its bands."""
    least = members.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("count")).where("count > 1")
    pairs = members.join(least, ["band", "key"]).where("id <> pivot").select("id", "pivot").distinct()
    a = corpus.classes.select("id", F.col("size").alias("a_size"), F.col("sketch").alias("a_sketch"))
    b = corpus.classes.select(F.col("id").alias("pivot"), F.col("size").alias("b_size"), F.col("sketch").alias("b_sketch"))
    near = pairs.join(a, "id").join(b, "pivot").where(_may_link(corpus.percent)).select("id", F.struct(_differ("a_sketch", "b_sketch").alias("differ"), "pivot").alias("near"))
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("near")), 1, PIVOTS).alias("near"))
    spread = stored(best.select("id", F.explode("near.pivot").alias("pivot")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    counts = spread.groupBy("pivot").agg(F.ceil(F.count("*") / SIDE).alias("parts"))
    spread = spread.join(counts, "pivot").withColumn("part", F.col("part") % F.col("parts"))
    cell = F.xxhash64("pivot", "part").alias("cell")
    others = spread.select(cell, F.lit(1).alias("side"), "id", F.col("id").alias("component"))
    pivots = spread.select("pivot", "part").distinct().select(cell, F.lit(0).alias("side"), F.col("pivot").alias("id"), F.col("pivot").alias("component"))
    return others.union(pivots)


def _further_cells(corpus: _Corpus, members: DataFrame, found: DataFrame) -> DataFrame:
    """In bands with several components, the members outside of the largest beside all members."""
    labelled = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = labelled.groupBy("band", "key", "component").count()
    bands = (
        counts.groupBy("band", "key")
        .agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("total"), F.count("*").alias("components"))
        .where("components > 1")
        .select(
            "band",
            "key",
            F.col("most.component").alias("largest"),
            F.ceil(F.col("most.count") / SIDE).cast("int").alias("inner_parts"),
            F.ceil((F.col("total") - F.col("most.count")) / SIDE).cast("int").alias("outer_parts"),
        )
    )
    rows = labelled.join(bands, ["band", "key"])
    inner = F.col("component") == F.col("largest")
    part = F.pmod(F.xxhash64("id", "band"), F.lit(1 << 20)).cast("int")
    own = F.when(inner, part % F.col("inner_parts")).otherwise(part % F.col("outer_parts"))
    numbers = F.sequence(F.lit(0), F.col("outer_parts") - 1)

    def cell(first: Column, kind: str, second: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("band", "key", first, F.lit(kind), second).alias("cell"), side.cast("int").alias("side"))

    # inner member: one cell for each part of the outer members; outer member: the cells of its part with
    # the inner parts, with itself, and with each other outer part, where the smaller part is side 0
    beside = F.transform(numbers, lambda k: cell(k, "inner", own, F.lit(1)))
    with_inner = F.transform(F.sequence(F.lit(0), F.col("inner_parts") - 1), lambda k: cell(own, "inner", k, F.lit(0)))
    with_outer = F.transform(numbers, lambda k: cell(F.least(own, k), "outer", F.greatest(own, k), F.when(own <= k, 0).otherwise(1)))
    cells = rows.select("band", "id", "component", F.explode(F.when(inner, beside).otherwise(F.concat(with_inner, with_outer))).alias("at"))
    cells = cells.select("at.cell", "at.side", "band", "id", "component")
    sketched = cells.join(corpus.classes.select("id", "size", "sketch", "bands"), "id")
    parted = sketched.repartition(_parts(sketched), "cell").sortWithinPartitions("cell")
    return stored(parted.mapInArrow(tidy(_candidates(corpus.percent)), "cell long, side int, id long, component long"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per id: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    corpus = _Corpus(documents, doc_id, text, shingle, percent)
    members = corpus.classes.select("id", F.posexplode("bands").alias("band", "key"))
    links = stored(corpus.links(stored(_first_cells(corpus, members))))
    further = corpus.links(_further_cells(corpus, members, components(links)))
    found = components(links.union(stored(further)))
    classes = corpus.classes.select("one", "two", "size", F.col("id").alias("class_id"))
    out = (
        corpus.documents.join(classes, ["one", "two", "size"], "left")
        .join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
        .withColumn("component_id", F.coalesce("component", "class_id", "id"))
    )
    return out.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
