"""Toxicity by non-negative positive-unlabelled learning.

The positives are confirmed toxic documents (at most ``MAX_POSITIVE``); the unlabelled set is all documents that take part
in learning, toxic ones among them. With the class prior p, the risk of a classifier g is p E+[l(g)] + max(0, Eu[l(-g)] -
p E+[l(-g)]): the second term estimates the risk on the negatives and cannot fall below 0; where it is negative, the step
is taken back instead. A linear numpy classifier on hashed words and word beginnings minimises it; its logits are
calibrated on labelled documents that were not among the positives. Labels, ids, languages and sources are never inputs
of a score.

All unlabelled documents count twice. One aggregation gives the share of them that has each feature, by which features
that say nothing are left out. Then each document is cut down to the other ones, a small written table, and the unlabelled
part of the risk and of its gradient is summed over that table in every step; documents without any of them share one
logit, so their number is enough.

Nulls: a null text is an empty one, and has a score. Null labels are not used; of several labels of a document the
largest counts. Without positives every score is the prior. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.linear import BITS, Adam, Rows, calibrate, collect_rows, fold, frequencies, reduced_rows, rows_of, sample, sigmoid, with_bias

#: Bounds of the samples that the classifier is fitted on.
MAX_POSITIVE, MAX_CALIBRATION = 2000, 2000
#: Documents with this remainder take no part in learning.
HELD_OUT, CALIBRATION = 2, 3
THRESHOLD = 0.3
#: Steps over all rows, and how far a step moves a weight at first.
STEPS, RATE = 30, 0.4
#: Standard errors by which a feature's share among positives must exceed its share among all.
MIN_Z = 5.0
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&…«»"


#: Characters that are hashed at a time; longer tokens are cut there.
CHARACTERS = 500_000
#: An odd number whose powers weigh a word's characters, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_HEADS = (3, 4, 5)
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is white space, and whether it is a mark that words are stripped of."""
    edge = np.zeros(0x110000, bool)
    edge[[ord(c) for c in _EDGE]] = True
    return np.array([chr(c).isspace() for c in range(0x110000)]), edge


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, x, np.uint64)))) for x in (_BASE, _INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _parts(lines: str) -> Iterator[tuple[int, str]]:
    """A text in parts that end at white space, or after ``CHARACTERS`` if there is none for as many more."""
    begin = 0
    while begin < len(lines):
        end = begin + CHARACTERS
        if end < len(lines):
            found = _SPACE.search(lines, end, end + CHARACTERS)
            end = found.start() if found else end + CHARACTERS
        yield begin, lines[begin:end]
        begin = end


class Words:
    """Hashed features of the words of whole texts, computed on their code points at once.

    A token (between white space, in small letters) gives its word without marks at its edges, and the word's first 3, 4
    and 5 letters, which carry stems. A word's hash is a polynomial of its code points, so the hash of any beginning is a
    difference of running sums.
    """

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and features of all texts, and the number of tokens of each."""
        low = [t.lower() for t in texts]
        lines, begins = "\n".join(low), np.cumsum([0, *(len(t) + 1 for t in low)])
        sizes, rows, ids = np.zeros(len(texts), np.int64), [], []
        blank, edge = _kinds()
        power, inverse = _powers(2 * CHARACTERS + 1)
        for begin, part in _parts(lines):
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            space = np.concatenate(([True], blank[codes], [True]))
            starts, ends = np.flatnonzero(space[:-1] & ~space[1:])[: len(codes)], np.flatnonzero(~space[:-1] & space[1:])
            if not len(starts):
                continue
            owner = np.searchsorted(begins, begin + starts, side="right") - 1
            sizes += np.bincount(owner, minlength=len(texts))
            core = ~(edge[codes] | space[1:-1])
            place = np.arange(len(codes))
            first = np.minimum.accumulate(np.where(core, place, len(codes))[::-1])[::-1][starts]
            last = np.maximum.accumulate(np.where(core, place, -1))[ends - 1] + 1
            real = first < ends
            owner, first, last = owner[real], first[real], last[real]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
            for head in (0, *_HEADS):
                some = slice(None) if not head else np.flatnonzero(last - first > head)
                a, b = first[some], first[some] + head if head else last
                hashed = _mixed((sums[b] - sums[a]) * inverse[a] + np.uint64(head))
                ids.append((hashed & np.uint64((1 << BITS) - 1)).astype(np.int64))
                rows.append(owner[some])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, ids)]
        return flat[0], flat[1], sizes

    def rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Features of each text, and how often it has them over the root of its number of tokens."""
        rows, ids, sizes = self.features(texts)
        pairs, times = np.unique(rows << BITS | ids, return_counts=True)
        cuts = np.searchsorted(pairs >> BITS, np.arange(1, len(texts)))
        values = times / np.sqrt(np.maximum(sizes, 1))[pairs >> BITS]
        return np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), cuts), np.split(values.astype(np.float32), cuts)

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """Logits without the bias."""
        rows, ids, sizes = self.features(texts)
        return np.bincount(rows, weights[ids], minlength=len(texts)) / np.sqrt(np.maximum(sizes, 1))


@dataclass
class Classifier:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, spark: SparkSession, text: Column) -> Column:
        """Probability that a text is toxic."""
        held = spark.sparkContext.broadcast((self.weights.astype(np.float32), self.slope, self.offset))

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights, slope, offset = held.value
            for batch in batches:
                out = np.empty(len(batch))
                for begin in range(0, len(batch), 100):
                    out[begin : begin + 100] = Words().scores([t or "" for t in batch.iloc[begin : begin + 100]], weights[:-1]) + weights[-1]
                yield pd.Series(sigmoid(slope * out + offset))

        return scored(text)


@dataclass
class Sums:
    """Of the unlabelled rows: their number, the sum of the loss l(-g), and the sums of its gradient (bias last)."""

    rows: int
    loss: float
    gradient: np.ndarray


def sums_of(rows: Rows, weights: np.ndarray, more: int = 0) -> Sums:
    """Sums over rows, and over ``more`` rows without features."""
    at, bias = rows.logits(weights[:-1]) + weights[-1], weights[-1]
    gradient = with_bias(rows, sigmoid(at))
    gradient[-1] += more * sigmoid(bias)
    return Sums(len(rows) + more, float(np.logaddexp(0, at).sum() + more * np.logaddexp(0, bias)), gradient)


def distributed(rows: DataFrame, number: int) -> Callable[[np.ndarray], Sums]:
    """``sums_of`` over a written table of ``ids, values`` and the rows without features that make up ``number``.

    Every task sums its rows, Spark adds the tasks' sums up by feature; the driver gets one row per feature in use.
    """
    spark, held = rows.sparkSession, rows.count()

    def sums(weights: np.ndarray) -> Sums:
        some = np.flatnonzero(weights[:-1])
        known = spark.sparkContext.broadcast((some, weights[some], weights[-1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, values, bias = known.value
            own, gradient, loss = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), 0.0
            own[places], own[-1] = values, bias
            for batch in batches:
                found = sums_of(rows_of(batch), own)
                gradient += found.gradient
                loss += found.loss
            used = np.flatnonzero(gradient)
            yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int64()), pa.array([*gradient[used].tolist(), loss])], ["id", "value"])

        total = rows.mapInArrow(run, "id long, value double").groupBy("id").agg(F.sum("value").alias("value")).toArrow()
        ids, values = total.column("id").to_numpy(), total.column("value").to_numpy()
        out = sums_of(Rows.of([], []), weights, number - held)
        out.gradient[ids[ids >= 0]] += values[ids >= 0]
        return Sums(number, out.loss + float(values[ids < 0].sum()), out.gradient)

    return sums


def fit_nnpu(positive: Rows, unlabelled: Callable[[np.ndarray], Sums], prior: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative risk with logistic loss, step by step over all rows."""
    model = Adam(rate)
    for step in range(steps):
        model.rate = rate * (1 - step / steps)
        at_p, u = model.logits(positive), unlabelled(model.weights)
        negative_risk = u.loss / u.rows - prior * np.logaddexp(0, at_p).mean()
        inner = u.gradient / u.rows - with_bias(positive, prior * sigmoid(at_p) / len(positive))
        if negative_risk < 0:
            model.move(-inner)
        else:
            model.move(with_bias(positive, prior * (sigmoid(at_p) - 1) / len(positive)) + inner)
    return model.weights


def telling(positive: Rows, frequency: np.ndarray, rows: int, limit: float = MIN_Z) -> np.ndarray:
    """Marks features that more of the positives have than chance allows, given how many of all ``rows`` have them."""
    share = (frequency + 1) / (rows + 2)
    z = (positive.frequency() / len(positive) - share) / np.sqrt(share * (1 - share) / len(positive))
    return (z > limit) & (positive.frequency() > 2)


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on bounded samples of the labelled documents and on all others that are not held out."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(fold() != HELD_OUT)
    counts = marks.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    prior = counts["toxic"] / max(1, counts["n"])
    known = docs.select("doc_id", "text")
    fit = fold() != CALIBRATION
    positives = sample(marks.filter((F.col("toxic") == 1) & fit), MAX_POSITIVE, 1)
    held = sample(marks.filter(~fit), MAX_CALIBRATION, 2)
    # The labelled samples; at most 4,000 ids are broadcast to pick them.
    picks = positives.select(F.col("doc_id").alias("_id"), F.lit(1).alias("part")).unionByName(held.select(F.col("doc_id").alias("_id"), (F.lit(2) + F.col("toxic")).cast("int").alias("part")))
    rows = known.join(F.broadcast(picks), F.col("doc_id") == F.col("_id")).select("text", F.col("part").cast("int").alias("part"))
    data, kept = collect_rows(rows, Words, ["part"])
    part = kept["part"]
    pool = known.filter((fold() != HELD_OUT) & fit).select("text")
    number, positive = pool.count(), np.flatnonzero(part == 1)
    if not len(positive) or not number:
        odds = np.log(prior / (1 - prior)) if 0 < prior < 1 else (-30.0 if prior == 0 else 30.0)
        return Classifier(np.zeros((1 << BITS) + 1), 0.0, float(odds))
    wanted = telling(data.take(positive), frequencies(pool, Words), number)
    data = data.only(wanted)
    weights = fit_nnpu(data.take(positive), distributed(reduced_rows(pool, Words, wanted), number), prior)
    check = np.flatnonzero(part >= 2)
    slope, offset = calibrate((data.take(check).logits(weights[:-1]) + weights[-1])[:, None], part[check] - 2)
    return Classifier(weights, float(slope), float(offset))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = learn(docs, labels)
    rows = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), model.score(docs.sparkSession, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
