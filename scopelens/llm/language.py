"""Language identification by words first, then by ever shorter character n-grams.

Learned from labelled texts, by counts over all of them: how often each word, and each character n-gram
of a word between marks of its ends, occurs in each language. A known word scores its logarithmic
frequency in each language. An unseen word is scored by its n-grams of the greatest size of which one
is known. The language with the highest sum is predicted; the score is its share among all languages
when sums are compared as probabilities.

The model is bounded: at most ``WORDS`` words and ``GRAMS`` n-grams, those of the highest shares in a
language; each has its counts in all languages. Words and n-grams beyond it, and those that occurred
once in each language, score as unseen.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text if
nothing was learned; rows with a null language are not learned from; equal sums go to the language
first by name; repeated rows count as often as they come; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.tables import stored

WORDS, GRAMS, SIZES = 200_000, 200_000, (4, 3, 2, 1)
#: Entries a task counts before it hands them on, and words a worker remembers.
COUNTED, REMEMBERED = 200_000, 400_000
#: Texts whose new words are scored together.
TOGETHER = 500
UNKNOWN = "und"
RESULT = "struct<lang_pred: string, score: double>"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORD.findall((text or "").lower())
    if (text or "").isascii():
        return found
    return [word for word in found if word.isalpha()] + [part for word in found if not word.isalpha() for part in _letters(word)]


def _letters(word: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in word).split()


def grams_of(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words between end marks (size 1: without), as word numbers and packed characters.

    A character takes 16 bits; those beyond the basic plane share one code.
    """
    marked = [f"<{word}>" for word in words] if size > 1 else words
    chars = np.minimum(np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    counts = np.maximum(lengths - size + 1, 0)
    number = np.repeat(np.arange(len(words)), counts)
    place = np.arange(len(number)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts)
    codes = np.zeros(len(number), np.uint64)
    for k in range(size):
        codes = (codes << np.uint64(16)) | chars[place + k]
    return number, codes


def _spelled(codes: np.ndarray, size: int) -> list[str]:
    parts = (codes[:, None] >> np.arange(16 * (size - 1), -1, -16, dtype=np.uint64)).astype(">u2")
    text = parts.tobytes().decode("utf-16-be", "surrogatepass")
    return [text[k : k + size] for k in range(0, len(text), size)]


def _packed(grams: list[str], size: int) -> np.ndarray:
    parts = np.frombuffer("".join(grams).encode("utf-16-be", "surrogatepass"), ">u2").reshape(-1, size).astype(np.uint64)
    return (parts << np.arange(16 * (size - 1), -1, -16, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _handed_on(counts: Counter) -> Iterator[pa.RecordBatch]:
    entries = iter(counts.items())
    while part := list(islice(entries, 20_000)):
        lang, size, entry = zip(*(key for key, _ in part), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(entry, pa.string()), pa.array([count for _, count in part], pa.int64())],
            ["lang", "size", "entry", "count"],
        )
    counts.clear()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (size 0) of texts by language."""
    counts: dict[str, Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            yield from _handed_on(Counter({(lang, 0, word): count for word, count in words.items()}))
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) >= COUNTED:
                yield from handed_on()
    yield from handed_on()


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of counted words by language and size."""
    counts: Counter = Counter()
    for batch in batches:
        langs, counted = np.asarray(batch.column("lang").to_pylist(), object), np.asarray(batch.column("count"), np.int64)
        for lang in dict.fromkeys(langs.tolist()):
            mine = np.flatnonzero(langs == lang)
            words = batch.column("entry").take(pa.array(mine)).to_pylist()
            for size in SIZES:
                number, codes = grams_of(words, size)
                if len(codes):
                    unique, which = np.unique(codes, return_inverse=True)
                    sums = np.bincount(which, counted[mine][number]).astype(np.int64)
                    for gram, count in zip(_spelled(unique, size), sums.tolist(), strict=True):
                        counts[lang, size, gram] += count
        if len(counts) >= COUNTED:
            yield from _handed_on(counts)
    yield from _handed_on(counts)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # to rows of word_scores
    word_scores: np.ndarray  # float32, one column for each language
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # size to sorted codes and their scores
    known: dict[str, int] = field(default_factory=dict)  # rows of ``table``, of words a worker remembers
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def _scored(self, words: list[str]) -> np.ndarray:
        """Known words by their own frequency, others by their n-grams of the greatest size with a known one."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        rows = np.fromiter((self.words.get(word, -1) for word in words), np.int64, len(words))
        out[rows >= 0] = self.word_scores[rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for size in SIZES:
            codes, scores = self.grams.get(size, (np.empty(0, np.uint64), out[:0]))
            if not len(left) or not len(codes):
                continue
            number, found = grams_of([words[k] for k in left.tolist()], size)
            at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            seen = codes[at] == found
            np.add.at(out, left[number[seen]], scores[at[seen]])
            left = np.delete(left, np.unique(number[seen]))
        return out

    def _remember(self, texts: list[Counter]) -> None:
        new = list({word for counts in texts for word in counts if word not in self.known})
        if self.table is None or len(self.known) + len(new) > len(self.table):
            self.known.clear()
            new = list({word for counts in texts for word in counts})
            self.table = np.empty((max(REMEMBERED, 2 * len(new)), len(self.languages)), np.float32)
        start = len(self.known)
        self.table[start : start + len(new)] = self._scored(new)
        self.known.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, column: pa.Array) -> pa.Array:
        names: list[str] = []
        shares: list[float] = []
        texts = column.to_pylist()
        for start in range(0, len(texts), TOGETHER):
            counted = [Counter(words_of(text)) for text in texts[start : start + TOGETHER]]
            if self.languages:
                self._remember(counted)
            for counts in counted:
                if not counts or not self.languages:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                each = self.table[np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))]
                total = np.fromiter(counts.values(), np.float64, len(counts)) @ each
                best = int(total.argmax())
                names.append(self.languages[best])
                shares.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang_pred", "score"])


def _most_shared(entries: DataFrame, most: int) -> DataFrame:
    """Entries of the highest shares, at most so many: whole classes of shares from the top, which takes no sort."""
    kind = F.floor(F.log2("share") * 8)
    classes = entries.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect()  # some hundred rows
    total, lowest = 0, 1
    for row in classes:
        total += row["count"]
        if total > most:
            break
        lowest = row["kind"]
    return entries.where(kind >= lowest)


def fit(texts: DataFrame, *, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learns from all rows with a language; select the training rows before."""
    known = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    entries, each = "lang string, size int, entry string, count long", ["lang", "size", "entry"]
    # words are counted over all texts, n-grams over the words, which are far fewer
    counted = stored(known.mapInArrow(_counted_words, entries).groupBy(*each).agg(F.sum("count").alias("count")))
    grams_counted = stored(counted.mapInArrow(_counted_grams, entries).groupBy(*each).agg(F.sum("count").alias("count")))
    counts = counted.union(grams_counted)
    total = counts.groupBy("lang", "size").agg(F.sum("count").alias("total"))
    totals = {(row["lang"], row["size"]): row["total"] for row in total.collect()}
    languages = sorted({name for name, _ in totals})
    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32), {})
    # one row for each language and size; what occurred once tells less than its n-grams
    best = counts.where("count > 1").join(F.broadcast(total), ["lang", "size"]).withColumn("share", F.col("count") / F.col("total"))
    tables = [_most_shared(best.where("size = 0"), words), _most_shared(best.where("size > 0"), grams)]
    number = {name: k for k, name in enumerate(languages)}
    tables_of: dict[int, dict[str, np.ndarray]] = {}
    for part in tables:
        # what is chosen for one language has its counts in the others too, however small
        part = counts.join(part.select("size", "entry").distinct(), ["size", "entry"], "left_semi")
        for name, size, entry, count in zip(*(column.to_pylist() for column in part.select("lang", "size", "entry", "count").toArrow().columns), strict=True):
            tables_of.setdefault(size, {}).setdefault(entry, np.zeros(len(languages)))[number[name]] = count
    scored: dict[int, tuple[list[str], np.ndarray]] = {}
    for size, found in tables_of.items():
        whole = np.array([max(1, totals.get((name, size), 1)) for name in languages], float)
        scored[size] = (list(found), np.log((np.array(list(found.values())) + 0.5) / (whole + 1)).astype(np.float32))
    spelled, word_scores = scored.pop(0, ([], np.zeros((0, len(languages)), np.float32)))
    packed = {}
    for size, (entries_, scores) in scored.items():
        codes = _packed(entries_, size)
        order = np.argsort(codes)
        packed[size] = (codes[order], scores[order])
    return Model(languages, {word: k for k, word in enumerate(spelled)}, word_scores, packed)


def predicted(model: Model, text: str = "text") -> Column:
    """Language and score of a text."""

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        return model.predict(texts)

    return predict(F.col(text))
