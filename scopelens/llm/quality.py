"""Quality by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are texts labelled good; everything else is unlabelled web text. With the share of
good texts (the class prior) estimated as pi, the risk of a scorer f over positives P and unlabelled U is

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

for the logistic loss l. The second term estimates the risk on bad texts and cannot be negative; where
it is, a step goes against it. The scorer is a sum of one weight per bin of each shape of the text
(repetition, capitals, symbols, lengths and so on), bins being quantiles of unlabelled text.

The prior is estimated from positives and unlabelled text alone: for a scorer that tells them apart, the share of
unlabelled text above a threshold over the share of positives above it is at least the prior, and equals
it where nothing bad scores as high. The least such quotient is taken, over thresholds that enough positives, which the
scorer has not seen, lie above. It may also be given.

Positives are a bounded sample. Everything about unlabelled text covers all of it: bins, the prior and the
risk. The scorer starts from a fit to a sample and then descends on the risk over all training documents: a pass
sums slopes and curvatures of tasks (one number for each bin of a shape), and ``PASSES`` of them are made.

Defined cases: null and empty texts have the lowest bins; null labels are not learned from; without
positives or unlabelled rows every score is the smoothed share of good labels (0.5 without labels); repeated rows count as
often as they come; equal measures get equal scores; texts of any length are measured whole; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelens.llm.logistic import sigmoid
from scopelens.llm.tables import stored

#: Positives learned from at most and unlabelled rows a fit starts from, in the order of a hash; bins of a shape.
SAMPLE_ROWS, BINS = 20_000, 16
#: Passes over all unlabelled text; for the prior, the share of positives that must lie above a threshold and the scorer's penalty.
PASSES, LEAST_ABOVE, TOLD_PENALTY = 12, 0.25, 0.03

_WORD = re.compile(r"\w+")
SHAPES = (
    "words", "distinct_words", "repeated_neighbours", "distinct_pairs", "word_length", "long_words", "short_words", "top_word",
    "distinct_lines", "line_words", "lines", "sentences", "capitals", "digits", "marks", "symbols", "spaces", "capital_words", "distinct_chars",
    "mixed_words", "bars", "urls", "bang",
)
_CLASSES = np.zeros(128, np.int64)
_CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 1
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 2
_CLASSES[ord("!")] = 3
_CLASSES[48:58] = 4
_CLASSES[65:91] = 5
_CLASSES[[32, 9, 10, 13]] = 6


def shapes(text: str | None) -> list[float]:
    """The measures of a whole text, in the order of SHAPES."""
    text = text or ""
    words = _WORD.findall(text)
    count, chars = max(1, len(words)), max(1, len(text))
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    ascii_codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    kinds = np.bincount(_CLASSES[ascii_codes], minlength=7)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    return [
        np.log1p(len(words)),
        len(set(words)) / count,
        same / count,
        len(set(zip(words, words[1:], strict=False))) / count,
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 12).sum()) / count,
        float((lengths < 3).sum()) / count,
        max(Counter(words).values(), default=0) / count,
        len(set(lines)) / max(1, len(lines)),
        count / max(1, len(lines)),
        np.log1p(len(lines)),
        (text.count(". ") + text.count(".\n") + 1) / count,
        kinds[5] / chars,
        kinds[4] / chars,
        kinds[1] / chars,
        kinds[2] / chars,
        kinds[6] / chars,
        upper / count,
        len(set(text)) / np.sqrt(chars),
        len(text.split()) / count,
        text.count("|") / chars,
        (text.count("http") + text.count("www.") + text.count("@")) / count,
        kinds[3] / chars,
    ]


def _measured(column: pa.Array) -> np.ndarray:
    return np.array([shapes(text) for text in column.to_pylist()], np.float64).reshape(len(column), len(SHAPES))


@dataclass
class Model:
    edges: np.ndarray  # shapes by bins - 1
    weights: np.ndarray  # shapes by bins
    bias: float

    def scores(self, measures: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[np.arange(len(SHAPES)), self.bins(measures)].sum(1) + self.bias)

    def bins(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], measures[:, k]) for k in range(len(SHAPES))], 1)


#: Places of a bin's edges among all texts, and weights but for the bias.
SPREAD, WIDTH = np.linspace(0, 1, BINS + 1)[1:-1], len(SHAPES) * BINS


def _flat(bins: np.ndarray) -> np.ndarray:
    return bins + np.arange(bins.shape[1]) * BINS


def fit_weights(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    *,
    edges: np.ndarray | None = None,
    counts: np.ndarray | None = None,
    steps: int = 2000,
    rate: float = 0.1,
    penalty: float = 1e-4,
) -> Model:
    """Adam on the non-negative risk over measures of positives and unlabelled texts; the mean of the second half's weights."""
    if edges is None:
        edges = np.quantile(unlabelled, SPREAD, axis=0).T
    model = Model(edges, np.zeros((len(SHAPES), BINS)), _logit(prior))
    p, u = _flat(model.bins(positive)), _flat(model.bins(unlabelled))
    times = np.ones(len(u)) if counts is None else counts
    share = times / times.sum()
    weights = np.append(np.zeros(WIDTH), model.bias)
    first, second, total = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    def spread_back(at: np.ndarray, errors: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at.ravel(), np.repeat(errors, at.shape[1]), WIDTH), errors.sum())

    for step in range(1, steps + 1):
        f_p, f_u = weights[p].sum(1) + weights[-1], weights[u].sum(1) + weights[-1]
        negative = share @ np.logaddexp(0, f_u) - prior * np.logaddexp(0, f_p).mean()
        slope_negative = spread_back(u, share * sigmoid(f_u)) - prior * spread_back(p, sigmoid(f_p) / len(p))
        if negative >= 0:
            slope = prior * spread_back(p, (sigmoid(f_p) - 1) / len(p)) + slope_negative
        else:
            slope = -slope_negative
        slope[:-1] += penalty * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            total += weights
    weights = total / (steps - steps // 2)
    return Model(edges, weights[:-1].reshape(len(SHAPES), BINS), float(weights[-1]))


def _logit(share: float) -> float:
    return float(np.log(share / (1 - share)))


def _sums(parts: np.ndarray, times: np.ndarray, model: Model) -> np.ndarray:
    """Over binned rows: slope and curvature of the loss as bad ones for each bin and the bias, the loss, and the rows."""
    at = parts.astype(np.int64) + np.arange(len(SHAPES)) * BINS
    f = model.weights.ravel()[at].sum(1) + model.bias
    s = sigmoid(f)
    slope, curve = times * s, times * s * (1 - s)
    spread = [np.bincount(at.ravel(), np.repeat(x, at.shape[1]), WIDTH) for x in (slope, curve)]
    return np.concatenate([spread[0], [slope.sum()], spread[1], [curve.sum()], [times @ np.logaddexp(0, f), times.sum()]])


def _binned(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, len(SHAPES))


def _pass(binned: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all tasks of an array that ``work`` makes of binned rows and how often they occur."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += work(_binned(batch), np.asarray(batch.column("times"), np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "part"])

    out = np.zeros(size)
    for row in binned.mapInArrow(summed, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).collect():
        out[row["place"]] = row["part"]
    return out


def estimated_prior(scores: np.ndarray, above: np.ndarray) -> float:
    """The prior from the scores of unseen positives, in ascending order, and the share of unlabelled text at or above each."""
    held = 1 - np.arange(len(scores)) / len(scores)
    enough = held >= LEAST_ABOVE
    # a quotient of few positives is uncertain: by two deviations of their share
    margin = 2 * np.sqrt(held * (1 - held) / len(scores))
    return float(np.clip((above[enough] / np.maximum(held[enough] - margin[enough], 1e-9)).min(), 0.01, 0.99))


def _descended(model: Model, positive: np.ndarray, binned: DataFrame, prior: float, penalty: float = 1e-4) -> Model:
    """Steps against the slope of the risk over all unlabelled text, each weight's by its curvature."""
    p = model.bins(positive)
    ones = np.ones(len(p)) / len(p)
    for _ in range(PASSES):
        u, own = _pass(binned, lambda parts, times: _sums(parts, times, model), 2 * WIDTH + 4), _sums(p, ones, model)  # noqa: B023  run before the next step
        rows, weights = u[-1], np.append(model.weights.ravel(), model.bias)
        slope_negative = u[: WIDTH + 1] / rows - prior * own[: WIDTH + 1]
        held = np.append(np.bincount((p + np.arange(len(SHAPES)) * BINS).ravel(), np.repeat(ones, len(SHAPES)), WIDTH), 1.0)
        negative = u[-2] / rows - prior * own[-2]
        slope = slope_negative - prior * (held - own[: WIDTH + 1]) if negative >= 0 else -slope_negative
        slope[:-1] += penalty * weights[:-1]
        # all shapes of a row move at once, so each by its part of the step
        curve = (len(SHAPES) + 1) * (u[WIDTH + 1 : 2 * WIDTH + 2] / rows) + penalty + 1e-6
        weights -= np.clip(slope / curve, -0.5, 0.5)
        model = Model(model.edges, weights[:-1].reshape(len(SHAPES), BINS), float(weights[-1]))
    return model


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    prior: float | None = None,
) -> Model:
    """Learns from the labelled good texts and all others without their labels; select the training rows before."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # at most sample_rows ids, so the texts need no shuffle
    chosen = known.where("label = 1").select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample_rows)
    good = texts.join(F.broadcast(chosen.distinct()), "id").select("text").mapInArrow(_sampled, "measures array<double>")
    positive = _rows(good.orderBy(F.xxhash64("measures"), "measures").limit(sample_rows))
    measured = stored(texts.select("text").mapInArrow(_sampled, "measures array<double>"))
    if not len(positive) or measured.isEmpty():
        counts = known.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
        share = ((counts["good"] or 0) + 1) / (counts["n"] + 2)
        return Model(np.zeros((len(SHAPES), BINS - 1)), np.zeros((len(SHAPES), BINS)), _logit(share))
    quantiles = measured.agg(*[F.percentile_approx(F.col("measures")[k], SPREAD.tolist(), 2000) for k in range(len(SHAPES))]).first()
    edges = np.array([list(x) for x in quantiles])
    binned = stored(measured.mapInArrow(_in_bins(edges), "bins binary").groupBy("bins").agg(F.count("*").alias("times")))
    start = binned.orderBy(F.xxhash64("bins"), "bins").limit(sample_rows).toArrow()
    middles = Model(edges, np.zeros((len(SHAPES), BINS)), 0.0)
    parts = np.frombuffer(b"".join(start.column("bins").to_pylist()), np.uint8).reshape(-1, len(SHAPES))
    sample, times = _inside(middles, parts), np.asarray(start.column("times"), np.float64)
    if prior is None:
        # half of the positives tell a scorer what they are like, the other half is seen for the first time
        shuffled = np.random.default_rng(7).permutation(len(positive))
        seen, unseen = shuffled[::2], shuffled[1::2]
        if len(unseen):
            told = fit_weights(positive[seen], sample, 0.5, edges=edges, counts=times, steps=400, penalty=TOLD_PENALTY)
            scores = np.sort(told.scores(positive[unseen]))
            above = _pass(binned, _above(told, scores), len(scores) + 1)
            prior = estimated_prior(scores, above[:-1] / above[-1])
        else:
            prior = 0.5
    return _descended(fit_weights(positive, sample, prior, edges=edges, counts=times), positive, binned, prior)


def _above(model: Model, scores: np.ndarray):
    def above(parts: np.ndarray, times: np.ndarray) -> np.ndarray:
        own = sigmoid(model.weights[np.arange(len(SHAPES)), parts].sum(1) + model.bias)
        # rows at or above each score, and all rows
        upto = np.bincount(np.searchsorted(scores, own, "right"), times, len(scores) + 1)
        return np.append(upto[::-1].cumsum()[::-1][1:], times.sum())

    return above


def _inside(model: Model, parts: np.ndarray) -> np.ndarray:
    """Measures that lie in the given bins: the upper edge of a bin, or beyond the last one."""
    upper = np.column_stack([model.edges, model.edges[:, -1] + 1])
    return upper[np.arange(len(SHAPES)), parts]


def _in_bins(edges: np.ndarray):
    model = Model(edges, np.zeros((len(SHAPES), BINS)), 0.0)

    def in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column("measures").flatten()).reshape(batch.num_rows, len(SHAPES))
            raw = model.bins(found).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in raw], pa.binary())], ["bins"])

    return in_bins


def _rows(measures: DataFrame) -> np.ndarray:
    column = measures.select("measures").toArrow().column("measures").combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, len(SHAPES))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(_measured(batch.column("text"))), pa.list_(pa.float64()))], ["measures"])


def score(model: Model, text: str = "text") -> Column:
    """The probability of a good text."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(_measured(texts)))

    return scored(F.col(text))
