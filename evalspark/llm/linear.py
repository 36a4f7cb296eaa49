"""Numpy linear classifiers on hashed features, trained on bounded samples; scoring runs in Spark tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from math import fsum
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import PartStore, slices, tidy
from evalspark.plans.shared import settle

BITS = 17
KEPT_TOKENS = 100_000
#: Tokens of which only a number or a few are kept.
KEPT_SUMS = 300_000
SLICE = 2_000_000


def bucket(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Rows:
    """Sparse rows: feature ids and values in a row, and where each row begins (one entry more than rows)."""

    ids: np.ndarray
    values: np.ndarray
    edges: np.ndarray

    def __len__(self) -> int:
        return len(self.edges) - 1

    def logits(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.ids] * self.values, dtype=np.float64)))
        return sums[self.edges[1:]] - sums[self.edges[:-1]]

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        """Sum of errors x rows."""
        spread = np.repeat(errors, np.diff(self.edges)) * self.values
        return np.bincount(self.ids, weights=spread, minlength=1 << BITS)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.edges)[rows]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.edges[:-1][rows] - edges[:-1], sizes) + np.arange(edges[-1])
        return Rows(self.ids[places], self.values[places], edges)

    def only(self, wanted: np.ndarray) -> Rows:
        """The same rows with the features marked in ``wanted``."""
        keep = wanted[self.ids]
        return Rows(self.ids[keep], self.values[keep], np.concatenate(([0], np.cumsum(keep)))[self.edges])

    def frequency(self) -> np.ndarray:
        """Number of rows that have each feature."""
        return np.bincount(self.ids, minlength=1 << BITS)

    @staticmethod
    def of(lists: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        edges = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        flat = (np.concatenate(lists), np.concatenate(values)) if lists else (np.zeros(0, np.int32), np.zeros(0, np.float32))
        return Rows(flat[0].astype(np.int64), flat[1].astype(np.float64), edges)


class Adam:
    """Weights of all features and a bias, moved by gradients."""

    def __init__(self, rate: float = 0.05, decay: float = 1e-6):
        self.weights, self.rate, self.decay, self.step = np.zeros((1 << BITS) + 1), rate, decay, 0
        self.mean, self.square = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def logits(self, rows: Rows) -> np.ndarray:
        return rows.logits(self.weights[:-1]) + self.weights[-1]

    def move(self, gradient: np.ndarray) -> None:
        gradient = gradient + self.decay * self.weights
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9**self.step), self.square / (1 - 0.999**self.step)
        self.weights -= self.rate * mean / (np.sqrt(square) + 1e-8)


def with_bias(rows: Rows, errors: np.ndarray) -> np.ndarray:
    return np.append(rows.gradient(errors), errors.sum())


def fit_logistic(rows: Rows, labels: np.ndarray, epochs: int = 20, batch: int = 500, seed: int = 7) -> np.ndarray:
    """Logistic regression with both classes weighing the same."""
    rng, model = np.random.default_rng(seed), Adam(decay=2e-3)
    share = np.array([max(1, (labels == c).sum()) for c in (0, 1)])
    weight = (len(labels) / (2 * share))[labels.astype(int)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            pick = order[begin : begin + batch]
            part = rows.take(pick)
            model.move(with_bias(part, weight[pick] * (sigmoid(model.logits(part)) - labels[pick]) / len(pick)))
    return model.weights


def calibrate(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Coefficients of the columns of ``logits`` and an offset, by Newton steps on Platt's smoothed targets."""
    width = logits.shape[1]
    positive, negative = (labels == 1).sum(), (labels == 0).sum()
    if not positive or not negative:
        return np.append(np.full(width, 1.0 / width), 0.0)
    goal = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = np.where(logits.std(axis=0) > 0, logits.std(axis=0), 1.0)
    x = np.column_stack([logits / scale, np.ones(len(logits))])
    at = np.append(np.full(width, 1.0 / width), 0.0)

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float(np.sum(np.logaddexp(0, z) - goal * z) + 1e-3 * a @ a)

    for _ in range(60):
        p = sigmoid(x @ at)
        gradient = x.T @ (p - goal) + 2e-3 * at
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(width + 1)
        move, step = np.linalg.solve(hessian, gradient), 1.0
        while loss(at - step * move) > loss(at) and step > 1e-6:
            step /= 2
        at = at - step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return np.append(at[:-1] / scale, at[-1])


class Kept(dict):
    """What ``make`` gives for a token, worked out once; emptied when it is full, which changes no result."""

    def __init__(self, make: Callable, limit: int = KEPT_SUMS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        found = self[token] = self.make(token)
        return found


class TokenWeights:
    """Sums of the weights of a token's features."""

    def __init__(self, buckets: Callable[[str], tuple[int, ...]], weights: np.ndarray):
        self.weights, plain = weights, weights.tolist()
        self.kept = Kept(lambda token: sum([plain[i] for i in buckets(token)]))

    def total(self, tokens: list[str]) -> float:
        return fsum(map(self.kept.__getitem__, tokens))


class Extractor:
    """Tokens to hashed features. ``of_token`` gives the features of one token, as strings; ``buckets``, if given, is a
    faster way to their hashes."""

    def __init__(
        self, of_token: Callable[[str], list[str]], split: Callable[[str], list[str]], repeats: str | None = None,
        buckets: Callable[[str], tuple[int, ...]] | None = None,
    ):
        self.split = split
        self.buckets = buckets or (lambda token: tuple(map(bucket, of_token(token))))
        #: Name of a feature that counts tokens equal to the one before, if that is wanted.
        self.repeats = None if repeats is None else bucket(repeats)
        self.store = PartStore(lambda tokens: [list(self.buckets(t)) for t in tokens], KEPT_TOKENS)
        self.weighed: TokenWeights | None = None

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of all texts in a row, where each text begins, and the number of tokens of each."""
        tokens = [self.split(t) for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        flat = list(chain.from_iterable(tokens))
        ids, sizes = self.store.ids(flat)
        edges = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        if self.repeats is not None:
            same = np.fromiter((a == b for a, b in zip(flat, flat[1:], strict=False)), bool, max(0, len(flat) - 1))
            same = np.concatenate((same, [False]))
            ends = np.cumsum(counts)
            same[ends[counts > 0] - 1] = False  # the next token is of another text
            number = np.concatenate(([0], np.cumsum(same)))
            extra = number[ends] - number[ends - counts]
            ids = np.insert(ids, np.repeat(edges[1:], extra), self.repeats)
            edges = edges + np.concatenate(([0], np.cumsum(extra)))
        return ids, edges, counts

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """Logits without the bias; a feature counts its occurrences over the root of the number of tokens.

        Sums of weights are kept per token for the array ``weights`` that was given last.
        """
        if self.weighed is None or self.weighed.weights is not weights:
            self.weighed = TokenWeights(self.buckets, weights)
        out = np.empty(len(texts))
        for row, text in enumerate(texts):
            tokens = self.split(text)
            total = self.weighed.total(tokens)
            if self.repeats is not None and weights[self.repeats]:
                total += weights[self.repeats] * sum(map(eq, tokens, islice(tokens, 1, None)))
            out[row] = total / np.sqrt(max(len(tokens), 1))
        return out

    def rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, edges, counts = self.flat(texts)
        found = [np.unique(ids[a:b], return_counts=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [f[0].astype(np.int32) for f in found], [(f[1] / np.sqrt(max(n, 1))).astype(np.float32) for f, n in zip(found, counts, strict=True)]


def collect_rows(docs: DataFrame, make: Callable[[], Extractor], keep: list[str], text: str = "text") -> tuple[Rows, dict[str, np.ndarray]]:
    """Hashed features of a bounded sample, extracted in tasks and brought to the driver with the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make()
        for batch in slices(batches, text, SLICE):
            ids, values = extractor.rows([t or "" for t in batch.column(text).to_pylist()])
            lists = [pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + lists, [*keep, "ids", "values"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    table = docs.select(*keep, text).mapInArrow(tidy(run), f"{kinds}, ids array<int>, values array<float>").toArrow().combine_chunks()
    return rows_of(table), {k: table.column(k).to_numpy() for k in keep}


def rows_of(table: pa.Table | pa.RecordBatch) -> Rows:
    """Rows from the columns ``ids`` and ``values``."""
    ids, values = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("ids"), table.column("values")))
    if not len(ids):
        return Rows.of([], [])
    edges = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).astype(np.int64)
    return Rows(ids.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64), edges)


def frequencies(docs: DataFrame, make: Callable, text: str = "text") -> np.ndarray:
    """In how many rows of ``docs`` each hashed feature occurs: one aggregation over all of them.

    ``make`` gives an extractor with ``features``: texts to (row, feature) pairs and the number of tokens of each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor, counts = make(), np.zeros(1 << BITS, np.int64)
        for batch in slices(batches, text, SLICE):
            rows, ids, _ = extractor.features([t or "" for t in batch.column(text).to_pylist()])
            # Pairs of a few thousand rows fit 31 bits, which sort faster.
            pairs = (rows << BITS | ids).astype(np.int32 if batch.num_rows < 1 << 13 else np.int64)
            counts += np.bincount(np.unique(pairs) & ((1 << BITS) - 1), minlength=1 << BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    summed = docs.select(text).mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BITS rows at most
    out = np.zeros(1 << BITS, np.int64)
    out[summed.column("id").to_numpy()] = summed.column("n").to_numpy()
    return out


def reduced_rows(docs: DataFrame, make: Callable, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """``ids, values`` of the rows that have a feature marked in ``wanted``, with these features only; a written table."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor, marked = make(), np.unpackbits(held.value).astype(bool)
        for batch in slices(batches, text, SLICE):
            rows, ids, sizes = extractor.features([t or "" for t in batch.column(text).to_pylist()])
            keep = marked[ids]
            pairs, times = np.unique(rows[keep] << BITS | ids[keep], return_counts=True)
            rows, ids = pairs >> BITS, pairs & ((1 << BITS) - 1)
            edges = np.concatenate((np.flatnonzero(np.diff(rows, prepend=-1)), [len(rows)]))
            values = (times / np.sqrt(sizes[rows])).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v)) for v in (ids.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays(lists, ["ids", "values"])

    return settle(docs.select(text).mapInArrow(tidy(run), "ids array<int>, values array<float>"), "reduced-rows")


def fold() -> Column:
    """0 to 3 from the document's id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def sample(df: DataFrame, limit: int, salt: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of doc_id; the same rows on each run. Small enough to broadcast."""
    return df.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(limit)
