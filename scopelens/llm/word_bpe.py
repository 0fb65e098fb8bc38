"""BPE encoding and decoding with word ends, by walking a trie of distinct words.

The vocabulary is a tokenizer file with lower-casing, NFC, word splitting, byte-level symbols and an
end-of-word suffix. The distinct words of a block of texts go into a trie. Walking it depth first, each
node gets the last token of the encoding of its prefix, so prefixes that words share are encoded once:
the last token at length i is the one token t that ends there for which the token before it and t
stay apart when merged on their own. A word's tokens are read back from its last one.

Merges are applied by rank, and a merge ranks after those that make its parts. So two tokens stay apart
unless a part at the end of the left one and a part at the start of the right one are a pair whose
rank comes before both parts are merged further (at equal rank the left merge comes first).

Defined cases: null texts are empty and have no tokens; special tokens in a text become their ids;
other columns are kept, one named as an output is replaced. Ids are stored as little-endian unsigned
32-bit integers.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from scopelens.llm.memory import forgets, tidy

#: Words whose tokens a worker remembers, and characters of text looked at together.
REMEMBERED, BLOCK_CHARS = 200_000, 1 << 19
_END = ""

#: The split of words that such files use, and the same spelled for Latin-1 characters, which Python's re matches faster.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.names = {number: name for name, number in self.vocabulary.items()}
        self.names |= {token["id"]: token["content"] for token in spec["added_tokens"]}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.latin = _LATIN if split == _SPLIT else None
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # inner and final tokens by their symbols; the longest number of symbols of each
        self.inner = {name: number for name, number in self.vocabulary.items() if not name.endswith(self.suffix)}
        self.final = {name.removesuffix(self.suffix): number for name, number in self.vocabulary.items() if name.endswith(self.suffix)}
        self.final.pop("", None)
        self.longest = (max(map(len, self.inner), default=0), max(map(len, self.final), default=0))
        symbols = _byte_symbols()
        self.bytes_to_symbols = {b: symbols[b] for b in range(256)}
        self.parts = {a + b: (a, b, rank) for (a, b), rank in self.ranks.items()}
        self.ordered = all(self.parts[x][2] < rank for pair, rank in self.ranks.items() for x in pair if x in self.parts)
        self.sound: dict[str, bool] = {}
        self.apart: dict[tuple[str, str, bool], bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank."""
        none = len(self.ranks)
        while len(symbols) > 1:
            ranks = [self.ranks.get(pair, none) for pair in zip(symbols[:-1], symbols[1:], strict=True)]
            least = min(ranks)
            if least == none:
                break
            best = ranks.index(least)
            pair = (symbols[best], symbols[best + 1])
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair:
                    out.append(symbols[k] + symbols[k + 1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The token and its parts at one side, each with the rank at which it is merged further."""
        out: list[tuple[str, float]] = [(token, float("inf"))]
        while token in self.parts:
            *pair, rank = self.parts[token]
            token = pair[side]
            out.append((token, rank))
        return out

    def _stay_apart(self, left: str, right: str, final: bool) -> bool:
        """Whether merging the symbols of both tokens gives these two; without ``left``, the one."""
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        end = self.suffix if final else ""
        symbols, whole = [*right[:-1], right[-1] + end], right + end
        if whole not in self.sound:
            self.sound[whole] = self._merged(symbols) == [whole]
        if not left or not self.sound[whole]:
            apart = self.sound[whole]
        elif self.ordered:
            starts = self._edge(whole, 0)
            apart = not any(
                rank < until_x and rank <= until_y
                for x, until_x in self._edge(left, 1)
                for y, until_y in starts
                if (rank := self.ranks.get((x, y))) is not None
            )
        else:
            apart = self._merged([*left, *symbols]) == [left, whole]
        self.apart[left, right, final] = apart
        return apart

    def _last_token(self, prefix: str, lasts: list[str], final: bool) -> str:
        """The last token of ``prefix``, given the last tokens of all shorter prefixes."""
        tokens, longest = (self.final, self.longest[1]) if final else (self.inner, self.longest[0])
        length = len(prefix)
        for start in range(max(0, length - longest), length):
            piece = prefix[start:]
            if piece in tokens:
                left = lasts[start]
                apart = self.apart.get((left, piece, final))
                if apart or (apart is None and self._stay_apart(left, piece, final)):
                    return piece
        raise ValueError(f"the vocabulary cannot spell {prefix!r}")

    def encode_words(self, words: set[str]) -> None:
        """Adds the tokens of words to what is known."""
        root: dict = {}
        for word in words:
            node = root
            for symbol in map(self.bytes_to_symbols.__getitem__, word.encode("utf-8", "surrogatepass")):
                node = node.setdefault(symbol, {})
            node[_END] = word
        # lasts[i]: last token of the current prefix of length i; a child is visited after its parent
        lasts = [""]
        waiting = [(symbol, "", child) for symbol, child in root.items()]
        while waiting:
            symbol, parent, node = waiting.pop()
            prefix = parent + symbol
            del lasts[len(prefix) :]
            if _END in node:
                word = node.pop(_END)
                tokens = [self.final[piece := self._last_token(prefix, lasts, True)]]
                rest = len(prefix) - len(piece)
                while rest:
                    piece = lasts[rest]
                    tokens.append(self.inner[piece])
                    rest -= len(piece)
                self.known[word] = b"".join(token.to_bytes(4, "little") for token in reversed(tokens))
            if node:
                lasts.append(self._last_token(prefix, lasts, False))
                waiting.extend((following, prefix, child) for following, child in node.items())

    def _split(self, text: str) -> list[str | bytes]:
        """Words, and the ids of special tokens."""
        if self.cuts is not None and self.cuts.search(text):
            out: list[str | bytes] = []
            for part in self.cuts.split(text):
                if part in self.special:
                    out.append(self.special[part].to_bytes(4, "little"))
                else:
                    out.extend(self._plain(part))
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list:
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        if self.latin is None:
            return self.words.findall(lowered)
        try:
            lowered.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(lowered)
        return self.latin.findall(lowered)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        split = [self._split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        new = {word for words in split for word in words if word not in self.known and isinstance(word, str)}
        if self.before:
            for word in new & self.before.keys():
                self.known[word] = self.before[word]
            new -= self.known.keys()
        gc.disable()  # a trie has no cycles, and looking for some in it takes as long as the walk
        try:
            self.encode_words(new)
        finally:
            gc.enable()
        known = self.known
        return [b"".join([known[word] if isinstance(word, str) else word for word in words]) for words in split]

    def encode(self, column: pa.Array) -> pa.Array:
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in column.to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                out.extend(self.encode_block(held))
                held, size = [], 0
        out.extend(self.encode_block(held))
        return pa.array(out, pa.binary())

    def decode(self, column: pa.Array) -> pa.Array:
        """Token names joined by a space, as a tokenizer file without a decoder asks for."""
        names = self.names
        return pa.array([" ".join([names[k] for k in memoryview(ids or b"").cast("I")]) for ids in column.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


forgets(_loaded.cache_clear)


def _each(kind: str, vocabulary: str, work: Callable[[WordBpe, pa.Array], pa.Array]):
    """A function of a column, whose worker keeps the vocabulary and known words for a task."""

    @F.arrow_udf(kind)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda columns: (work(_loaded(vocabulary), column) for column in columns))(batches)

    return each


def encoded(vocabulary: str, text: str = "text") -> Column:
    """The ids of a text; ``vocabulary`` is the tokenizer file's place on every executor."""
    return _each("binary", vocabulary, WordBpe.encode)(F.col(text))


def decoded(vocabulary: str, ids: str = "ids") -> Column:
    """The text of ids made by ``encoded``."""
    return _each("string", vocabulary, WordBpe.decode)(F.col(ids))


def coded(vocabulary: str, text: str = "text") -> Column:
    """Both at once: a struct of the ``ids`` of a text and the text they are ``decoded`` to."""

    def code(bpe: WordBpe, texts: pa.Array) -> pa.Array:
        ids = bpe.encode(texts)
        return pa.StructArray.from_arrays([ids, bpe.decode(ids)], ["ids", "decoded"])

    return _each("struct<ids: binary, decoded: string>", vocabulary, code)(F.col(text))
