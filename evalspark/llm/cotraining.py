"""Quality classifier by co-training two views of a document.

The content view sees the words: their shapes, edges and repeats. The page view sees metadata: source, language, length
and layout. Both start from the same labelled documents; in each round the rows of an unlabelled pool on which one view
is most confident are given, with its label, to the other. Each view is then calibrated on labelled documents that
neither was trained on, and the calibrated views are combined to one probability of good quality.

Nulls: null texts are empty, null metadata is a value of its own. Null labels are not used; of several labels of a
document the smallest counts. Without labels of both classes every score is the share of good ones (0.5 without labels)
and all documents are kept. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.linear import BITS, Extractor, Rows, calibrate, collect_rows, fit_logistic, fold, sample, sigmoid

#: Bounds of the samples that the classifiers are fitted on.
MAX_LABELLED, MAX_POOL, MAX_CALIBRATION = 3000, 3000, 2000
#: Documents with these remainders are not trained on.
HELD_OUT, CALIBRATION = 2, 3
ROUNDS = 4
#: Share of the pool that a view hands over in a round.
HANDED_OVER = 0.1
THRESHOLD = 0.5
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&…«»"


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits become A, a and 0; marks stay, repeated ones once."""
    out = []
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def content_features(token: str) -> list[str]:
    return [f"s:{shape(token)}", f"e:{token[-3:]}", f"w:{token.strip(_EDGE).lower()}"]


def content_view() -> Extractor:
    return Extractor(content_features, str.split, repeats="=previous")


def page_view() -> Extractor:
    return Extractor(lambda token: [token], str.split)


def page_text(text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """The page's metadata as words, one per property; numbers fall into bins of a logarithm or a share."""
    text = F.coalesce(text, F.lit(""))
    length = F.coalesce(n_chars.cast("double"), F.length(text).cast("double"))
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.regexp_count(text, F.lit("\n")) + 1

    def log(value: Column) -> Column:
        return F.floor(2 * F.log2(F.greatest(value, F.lit(1.0)))).cast("string")

    def share(value: Column) -> Column:
        return F.floor(20 * value / size).cast("string")

    word = lambda name, value: F.concat(F.lit(f"{name}:"), F.coalesce(F.translate(value, " \t\n\r", ""), F.lit("?")))
    return F.concat_ws(
        " ", word("source", source), word("lang", lang), word("chars", log(length)), word("lines", log(lines.cast("double"))),
        word("line", log(size / lines)), word("capitals", share(F.regexp_count(text, F.lit(r"\p{Lu}")))),
        word("marks", share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")))), word("gaps", share(F.regexp_count(text, F.lit(r"\s")))),
    )


@dataclass
class Classifier:
    content: np.ndarray
    page: np.ndarray
    #: Of the content view, of the page view, and an offset.
    mix: np.ndarray

    def score(self, spark: SparkSession, text: Column, page: Column) -> Column:
        """Probability of good quality."""
        held = spark.sparkContext.broadcast((self.content.astype(np.float32), self.page.astype(np.float32), self.mix))

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            content, page, mix = held.value
            views = [(view, weights[:-1], weights[-1]) for view, weights in ((content_view(), content), (page_view(), page))]
            for columns in batches:
                out = np.full(len(columns[0]), mix[-1])
                for column, (view, weights, bias), factor in zip(columns, views, mix, strict=False):
                    out += factor * (view.scores([t or "" for t in column], weights) + bias)
                yield pd.Series(sigmoid(out))

        return scored(text, page)


def cotrain(views: list[Rows], labels: np.ndarray, pool: list[Rows], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of each view. ``labels`` belong to the rows of ``views``; the rows of ``pool`` have none."""

    def logits(weights: np.ndarray, rows: Rows) -> np.ndarray:
        return rows.logits(weights[:-1]) + weights[-1]

    size = len(pool[0])
    given = [np.full(size, -1), np.full(size, -1)]  # labels that each view got from the other
    weights: list[np.ndarray] = []
    for turn in range(rounds + 1):
        weights = []
        for k in (0, 1):
            got = np.flatnonzero(given[k] >= 0)
            both = [views[k], pool[k].take(got)]
            rows = Rows(
                np.concatenate([r.ids for r in both]), np.concatenate([r.values for r in both]),
                np.concatenate([both[0].edges, both[0].edges[-1] + both[1].edges[1:]]),
            )
            weights.append(fit_logistic(rows, np.concatenate((labels, given[k][got]))))
        if turn == rounds or not size:
            break
        for k in (0, 1):
            other, z = 1 - k, logits(weights[k], pool[k])
            free = np.flatnonzero(given[other] < 0)
            # As many of each class as the labels have, taken from both ends of the view's ranking.
            number = HANDED_OVER * size
            for label, order in ((1, free[np.argsort(-z[free], kind="stable")]), (0, free[np.argsort(z[free], kind="stable")])):
                top = order[: int(number * (labels == label).mean())]
                sure = top[(z[top] > 0) == (label == 1)]
                given[other][sure] = label
    return weights


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit both views on bounded samples of the documents that are not held out."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.filter(fold() != HELD_OUT)
    train, check = sample(marks.filter(fold() != CALIBRATION), MAX_LABELLED, 4), sample(marks.filter(fold() == CALIBRATION), MAX_CALIBRATION, 5)
    # 2 and 3: labels to train on; 4 and 5: to calibrate with; 1: the pool.
    picks = train.select(F.col("doc_id").alias("_id"), (F.col("quality") + 2).cast("int").alias("_part")).unionByName(
        check.select(F.col("doc_id").alias("_id"), (F.col("quality") + 4).cast("int").alias("_part"))
    )
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars")
    pool = (fold() != HELD_OUT) & (fold() != CALIBRATION)
    share = min(1.0, 2 * MAX_POOL / max(1, rows.count()))  # half of the rows are in the two folds
    drawn = pool & (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.join(F.broadcast(picks), F.col("doc_id") == F.col("_id"), "left").withColumn("part", F.coalesce("_part", F.when(drawn, 1).otherwise(0)))
    rows = rows.filter(F.col("part") > 0).select("part", "doc_id", "text", page_text(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars")).alias("page"))
    found = []
    for view, column in ((content_view, "text"), (page_view, "page")):
        data, kept = collect_rows(rows, view, ["part", "doc_id"], column)
        order = np.lexsort((kept["doc_id"], kept["part"]))  # both views in the same order
        found.append(data.take(order))
        part = kept["part"][order]
    labelled, calibration = np.flatnonzero((part == 2) | (part == 3)), np.flatnonzero(part >= 4)
    good = part[labelled] - 2
    if not len(good) or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        odds = np.log((share + 1e-9) / (1 - share + 1e-9)) if len(good) else 0.0
        empty = np.zeros((1 << BITS) + 1)
        return Classifier(empty, empty, np.array([0.0, 0.0, odds]))
    # All features take part, also those that only the pool has; the decay in fit_logistic holds chance ones down.
    weights = cotrain([v.take(labelled) for v in found], good, [v.take(np.flatnonzero(part == 1)) for v in found])
    if not len(calibration):
        calibration = labelled
    truth = part[calibration] % 2
    # Each view gets its own probability scale first; then their log-odds are combined.
    at = [v.take(calibration).logits(w[:-1]) + w[-1] for v, w in zip(found, weights, strict=True)]
    own = [calibrate(z[:, None], truth) for z in at]
    final = calibrate(np.column_stack([c[0] * z + c[1] for c, z in zip(own, at, strict=True)]), truth)
    mix = np.array([final[0] * own[0][0], final[1] * own[1][0], final[2] + final[0] * own[0][1] + final[1] * own[1][1]])
    return Classifier(weights[0], weights[1], mix)


def score_column(docs: DataFrame, model: Classifier) -> Column:
    return model.score(docs.sparkSession, F.col("text"), page_text(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars")))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, kept`` for every row."""
    rows = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), score_column(docs, learn(docs, labels)).alias("score"))
    return rows.withColumn("kept", F.col("score") >= THRESHOLD)
