"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased text, hashed. Over labelled
training texts Spark counts in how many toxic and other texts each n-gram occurs; its log-count
ratio r = ln((t / T) / (o / O)) scales the feature, and a logistic regression is fitted on the scaled
features. Only n-grams whose chi-square statistic is among the ``features`` highest carry a weight.

Defined cases: null and empty texts have no n-grams and get the score of the bias alone; rows with
a null label, and labels of unknown documents, are not learned from; repeated rows count as often as they come; without
training rows of both classes every score is the smoothed share of toxic rows (0.5 without any).
Other columns are kept; an existing column named as an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.blocks import mixed
from scopelens.llm.logistic import fit_sparse, sigmoid
from scopelens.llm.memory import tidy

#: Labelled rows learned from at most, taken in the order of a hash of their ids.
SAMPLE_ROWS = 24_000
#: n-gram sizes, hash places, and n-grams with a weight.
SIZES, BITS, FEATURES = (3, 4, 5, 6), 20, 4_000
#: Texts that must hold an n-gram before it can carry a weight.
LEAST_TEXTS = 5
#: Characters of text looked at together.
CHARS = 1 << 18


def _text_blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts, first, size = column.to_pylist(), 0, 0
    for row, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARS:
            yield first, [x or "" for x in texts[first : row + 1]]
            first, size = row + 1, 0
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: the hash place at each character, the row there, and the row at the n-gram's end."""
    lowered = [f" {x.lower()} " for x in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    codes = mixed(chars.astype(np.uint64) + np.uint64(1)).astype(np.uint32)
    for size in SIZES:
        count = max(0, len(chars) - size + 1)
        place = np.full(count, size, np.uint32)
        for k in range(size):
            place *= np.uint32(0x01000193)
            place ^= codes[k : k + count]
        place ^= place >> np.uint32(15)
        place *= np.uint32(0x2C1B3C6D)
        yield place >> np.uint32(32 - BITS), rows[:count], rows[size - 1 :]


def distinct_places(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs; with ``wanted``, the number that it gives a place, if not -1."""
    if wanted is None:
        return _all_places(texts)
    found = []
    for place, first, last in grams(texts):
        number = wanted[place]
        at = np.flatnonzero(number >= 0)
        at = at[first[at] == last[at]]
        found.append((first[at].astype(np.int64) << BITS) | number[at])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _all_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places are marked with the last position that holds them, which is cheaper than sorting all of a text's."""
    parts = [(place, first, last, np.searchsorted(first, np.arange(len(texts) + 1))) for place, first, last in grams(texts)]
    mark = np.zeros(1 << BITS, np.int32)
    rows, places = [], []
    for row in range(len(texts)):
        own = []
        for place, first, last, bounds in parts:
            a, b = bounds[row], bounds[row + 1]
            own.append(place[a:b][last[a:b] == row])
        place = np.concatenate(own)
        number = np.arange(len(place), dtype=np.int32)
        mark[place] = number
        place = place[mark[place] == number]
        rows.append(np.full(len(place), row))
        places.append(place.astype(np.int64))
    return np.concatenate(rows), np.concatenate(places)


@dataclass
class Model:
    numbers: np.ndarray  # int32 per hash place, -1 without a weight
    weights: np.ndarray  # per number, ratio times coefficient
    bias: float

    def scores(self, column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for first, texts in _text_blocks(column):
            rows, numbers = distinct_places(texts, self.numbers)
            out[first : first + len(texts)] = sigmoid(np.bincount(rows, self.weights[numbers], len(texts)) + self.bias)
        return pa.array(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by hash place and label, one row for each place of a partition."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = np.asarray(batch.column("label").to_pylist(), np.int64)
        for first, texts in _text_blocks(batch.column("text")):
            rows, places = distinct_places(texts)
            for label in (0, 1):
                counts[label] += np.bincount(places[labels[first + rows] == label], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], ["place", "toxic", "other"])


def fit(documents: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """Learns from the labelled documents; select the training rows before."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    chosen = known.orderBy(F.xxhash64("id", "label"), "id", "label").limit(sample_rows)
    # at most sample_rows rows of an id and a label each, so the texts need no shuffle
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("text", "label")
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    none = Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), float(np.log((toxic + 1) / (other + 1))))
    if not toxic or not other:
        return none
    t, o = F.col("toxic"), F.col("other")
    rest_t, rest_o, total = toxic - t, other - o, float(toxic + other)
    square = (t * rest_o - o * rest_t) * 1.0
    chi = square * square * total / ((t + o) * 1.0 * (rest_t + rest_o + 1) * toxic * other)
    best = (
        sample.mapInArrow(tidy(_counted), "place long, toxic long, other long")
        .groupBy("place")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(t + o >= LEAST_TEXTS)
        .select("place", F.log(((t + 1) / (toxic + 2)) / ((o + 1) / (other + 2))).alias("ratio"), chi.alias("chi"))
        .orderBy(F.desc("chi"), "place")
        .limit(features)
        .collect()
    )
    numbers, ratios = none.numbers, np.array([row["ratio"] for row in best] or [0.0])
    numbers[[row["place"] for row in best]] = np.arange(len(best))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0, np.int64)] * batch.num_rows
            for first, texts in _text_blocks(batch.column("text")):
                rows, found = distinct_places(texts, numbers)
                bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    out[first + k] = found[bounds[k] : bounds[k + 1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.int32()))], ["label", "found"])

    known = sample.mapInArrow(tidy(listed), "label int, found array<int>").toArrow()
    found = known.column("found").combine_chunks()
    columns = np.asarray(found.flatten())
    rows = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths()))
    answers = np.asarray(known.column("label"), float)
    weights, bias = fit_sparse(rows, columns, ratios[columns], answers, len(ratios))
    return Model(numbers, weights * ratios, bias)


def score(model: Model, text: str = "text") -> Column:
    """The probability of a toxic text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda texts: map(model.scores, texts))(batches)

    return scored(F.col(text))
