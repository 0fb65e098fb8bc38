"""Token ids in binary files of compressed bit planes.

Texts are encoded, each followed by an end id, and written in ascending order of their ids, a file for
each range of ids. A file holds blocks of ``BLOCK`` ids; a block is transposed into bit planes (all
lowest bits, all next bits and so on), and each plane is compressed by zstandard, so that the
upper planes, which seldom change, nearly vanish.

    file    = "BITP1\\0\\0\\0", blocks, footer, length of the footer (8 bytes), "BITP1\\0\\0\\0"
    block   = planes one after the other, lowest bit first
    footer  = zstandard of JSON: ids in all; for each block its offset, count of ids and the sizes of its
              planes; documents and the first id of each (base64 of little-endian 64-bit integers)

Files are written under a name of the attempt and renamed, so a task that runs again replaces its file.

Defined cases: null texts are empty and hold the end id alone; rows with a null id are left out;
rows of the same id follow each other in the order of their texts; an empty table gives no file with documents; other
columns are ignored; special tokens in a text become their ids, as the library does it.
"""

from __future__ import annotations

import base64
import gc
import json
import uuid
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from scopelens.llm.tables import stored

MAGIC = b"BITP1\0\0\0"
#: Ids of a block, compression level, words a worker remembers, and characters of text looked at together, and new words
#: encoded together.
BLOCK, LEVEL, REMEMBERED, BLOCK_CHARS, BLOCK_WORDS = 1 << 16, 3, 300_000, 1 << 21, 1 << 15
#: Bytes of text for a file, on average.
FILE_BYTES = 24 << 20


def planes(ids: np.ndarray) -> list[bytes]:
    """The bits of 32-bit ids, lowest first, up to the highest in use."""
    count = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(count)]


def from_planes(parts: list[bytes], count: int) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    for k, part in enumerate(parts):
        ids |= np.unpackbits(np.frombuffer(part, np.uint8), count=count, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class Writer:
    def __init__(self, stream):
        self.stream, self.place = stream, 0
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.blocks: list[list] = []
        self.documents: list[int] = []
        self.starts: list[int] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, document: int, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.starts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for start in range(0, end, BLOCK):
            part = ids[start : min(start + BLOCK, end)]
            packed = [self.compressor.compress(plane) for plane in planes(part)]
            self.blocks.append([self.place, len(part), [len(x) for x in packed]])
            for x in packed:
                self._put(x)
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        packed = {
            name: base64.b64encode(np.array(values, "<i8").tobytes()).decode()
            for name, values in (("documents", self.documents), ("starts", self.starts))
        }
        footer = self.compressor.compress(json.dumps({"ids": self.total, "blocks": self.blocks, **packed}).encode())
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Documents of a file, block by block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < 2 * len(MAGIC) + 8 or self._bytes(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a complete file of bit planes")
        length = int.from_bytes(self._bytes(size - len(MAGIC) - 8, 8), "little")
        footer = json.loads(zstandard.decompress(self._bytes(size - len(MAGIC) - 8 - length, length)))
        self.ids, self.blocks = footer["ids"], footer["blocks"]
        self.documents, self.starts = (np.frombuffer(base64.b64decode(footer[name]), "<i8") for name in ("documents", "starts"))

    def _bytes(self, place: int, count: int) -> bytes:
        self.file.seek(place)
        return self.file.read(count)

    def _blocks(self) -> Iterator[np.ndarray]:
        for place, count, sizes in self.blocks:
            data, at, parts = self._bytes(place, sum(sizes)), 0, []
            for size in sizes:
                parts.append(zstandard.decompress(data[at : at + size]))
                at += size
            yield from_planes(parts, count)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Document, its first id's number in the file, its ids."""
        ends = np.append(self.starts[1:], self.ids)
        held, first, blocks = np.empty(0, np.uint32), 0, self._blocks()
        for document, start, end in zip(self.documents.tolist(), self.starts.tolist(), ends.tolist(), strict=True):
            parts, have = [held], first + len(held)
            while have < end:
                parts.append(next(blocks))
                have += len(parts[-1])
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield document, start, held[start - first : end - first]
            held, first = held[end - first :], end


#: Kinds of characters, as the tokenizer's own pattern tells them apart, and the end of a text:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_LETTER, _NUMBER, _OTHER, _BLANK, _END = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds, every = np.full(0x110000, _OTHER, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    return kinds


def _starts(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words of texts begin, each text with one more character behind it, at ``ends``, which is a word too."""
    kinds = _kinds()[chars]
    kinds[ends] = _END
    word, space = kinds < _BLANK, chars == ord(" ")
    start = np.ones(len(chars), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start[1:] &= ~(space[:-1] & word[1:])  # a space goes with the word behind it,
    start[:-1] |= (kinds[:-1] == _BLANK) & word[1:]  # and leaves other blanks before it
    start[ends] = True
    start[ends[:-1] + 1] = True
    at = np.flatnonzero((chars == ord("'")) & start)
    at = at[kinds[at + 1] == _LETTER]  # so two more characters follow
    first, second = chars[at + 1], chars[at + 2]
    for letter in "stmd":
        found = at[first == ord(letter)]
        start[found + 1], start[found + 2] = False, True
    for one, two in ("re", "ve", "ll"):
        found = at[(first == ord(one)) & (second == ord(two))]
        start[found + 1], start[found + 3] = False, True
    return np.flatnonzero(start)


def _strings(words: pa.LargeBinaryArray) -> list[str]:
    """Words of 32-bit characters, all decoded at once."""
    _, places, data = words.buffers()
    places = np.frombuffer(places, "<i8", len(words) + 1)
    every = data[: int(places[-1])].to_pybytes().decode("utf-32-le")
    return [every[start:end] for start, end in pairwise((places // 4).tolist())]


def _shown_bytes() -> dict[int, int]:
    """The characters that byte-level vocabularies spell bytes with: themselves if printable, or else the next from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 256 + place for place, byte in enumerate(x for x in range(256) if x not in shown)}


_SHOWN = _shown_bytes()
#: The character for each byte; 0xff, which UTF-8 has not, stands between words.
_SPELLING = "".join("\n" if byte == 0xFF else chr(_SHOWN.get(byte, byte)) for byte in range(256))


class ByteBpe:
    """A byte-level tokenizer; each distinct word goes to the library once while it is remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        #: whether words are what ``_starts`` finds
        self.splits = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.splits = self.splits and spec["truncation"] is None and spec["padding"] is None
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: the model without the steps around it, for words spelled in bytes, a line each
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.model.get_vocab()
        #: and tokens spell all of a word and nothing else, so their lengths tell words apart
        self.splits = self.splits and spec["model"]["type"] == "BPE" and not any(spec["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.splits = self.splits and all(chr(_SHOWN.get(byte, byte)) in vocabulary for byte in range(256))
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of Latin-1 characters go to the model itself, as the steps before it would find each whole again.

        Others take these steps too: which characters are letters differs between versions of Unicode.
        """
        latin, others = [], []
        for word in words:
            (latin if word.isascii() or max(word) <= "\xff" else others).append(word)
        for some in batched(latin, BLOCK_WORDS):
            yield from zip(some, self._spelled(some), strict=True)
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else []
        yield from ((word, np.array(found.ids, "<u4").tobytes()) for word, found in zip(others, encoded, strict=True))

    def _spelled(self, words: tuple[str, ...]) -> list[bytes]:
        """Ids of words, all encoded at once; the lengths of the tokens tell where each ends."""
        lines = charmap_decode("\uffff".join(words).encode().replace("\uffff".encode(), b"\xff"), "strict", _SPELLING)[0]
        ids = np.array(self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, lines.split("\n")), np.int64, len(words)))
        cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[start:end] for start, end in zip(chain((0,), cuts), cuts, strict=False)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        unseen = [word for word, ids in zip(words, found, strict=True) if ids is None]
        remembered = {word: self.before[word] for word in unseen if word in self.before}
        learned = remembered | dict(self._new([word for word in unseen if word not in remembered]))
        self.known |= learned
        return [learned[word] if ids is None else ids for word, ids in zip(words, found, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, texts: list[str], last: bytes) -> Iterator[np.ndarray]:
        """Ids of texts by their words, of which Arrow finds the distinct ones."""
        chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = _starts(chars, ends)
        places = pa.py_buffer(np.append(starts, len(chars)) * chars.itemsize)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(chars)]).dictionary_encode()
        numbers = words.indices.to_numpy().copy()
        text_ends = np.searchsorted(starts, ends)
        numbers[text_ends] = len(words.dictionary)  # the end id
        found = pa.array([*self._ids(_strings(words.dictionary)), last], pa.large_binary()).take(pa.array(numbers))
        places = np.frombuffer(found.buffers()[1], "<i8")[np.append(0, text_ends + 1)] // 4
        ids = np.frombuffer(found.buffers()[2], "<u4", places[-1])
        return (ids[start:end] for start, end in pairwise(places.tolist()))

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        last = end.to_bytes(4, "little")
        # a text with special tokens goes to the library whole, and so do all where words cannot be told apart here
        whole = [not self.splits or any(x in text for x in self.special) for text in texts]
        split = [text for text, alone in zip(texts, whole, strict=True) if not alone]
        ids = self._split(split, last) if split else iter(())
        return [np.frombuffer(self._whole(text) + last, "<u4") if alone else next(ids) for text, alone in zip(texts, whole, strict=True)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteBpe(path)


def _written(folder: str, vocabulary: str, end: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        final, trial = f"{place}/part-{part:06d}.bitp", f"{place}/.part-{part:06d}-{uuid.uuid4().hex}"
        bpe = _loaded(vocabulary)
        gc.freeze()  # what a worker remembers has no cycles to look for
        with system.open_output_stream(trial) as stream:
            writer = Writer(stream)
            for batch in batches:
                ids, texts = batch.column("id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
                start = size = 0
                for row, text in enumerate(texts):
                    size += len(text)
                    if size >= BLOCK_CHARS or row + 1 == len(texts):
                        for document, found in zip(ids[start : row + 1], bpe.encode(texts[start : row + 1], end), strict=True):
                            writer.add(document, found)
                        start, size = row + 1, 0
            writer.close()
        system.move(trial, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([f"part-{part:06d}.bitp"]), pa.array([len(writer.documents)], pa.int64()), pa.array([writer.total], pa.int64())],
            ["part", "file", "documents", "ids"],
        )

    return written


def write(documents: DataFrame, folder: str, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 2, files: int | None = None) -> DataFrame:
    """Writes the files into a folder that all executors share; one row per file, in ascending order of ids."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    session = documents.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = files or max(-(-total // FILE_BYTES), session.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(count, "id").sortWithinPartitions("id", "text")
    return stored(ranged.mapInArrow(_written(folder, vocabulary, end), "part long, file string, documents long, ids long"))


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with system.open_input_file(f"{place}/{name}") as file:
                    rows: list[tuple] = []
                    size = 0
                    for document, start, ids in Reader(file):
                        rows.append((document, before + start, len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size >= BLOCK * 16:
                            yield _batch(rows, kinds)
                            rows, size = [], 0
                    yield _batch(rows, kinds)

    return read


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["id", "start", "n_tokens", "ids"])


def read(files: DataFrame, folder: str, *, doc_id: str = "doc_id") -> DataFrame:
    """Documents from written files: id, ``start`` among all ids, ``n_tokens`` and ``ids`` (little-endian 32-bit)."""
    # one row per file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.where("documents > 0").select("part", "file", before.alias("before"))
    count = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(count, "part").mapInArrow(_read(folder), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", doc_id)


def digest(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return documents.select(doc_id, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
