"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are scored for a set of query items. A document's term has an impact that follows from its frequency and the
document's length; an item's score of a document is the sum of weight times impact over the item's terms. The documents
are one pass of tokenising, of which only the postings of query terms are kept, as a written table. Then each task lays its
postings out in shards, and every shard has a list per term, ordered by falling impact, and direct access by (document,
term).

For an item, the lists of its terms are read side by side from the top. Each document that turns up is looked up in all
of them by direct access, which completes its score and also marks the places at which it stands there. A list's best
position is the last one up to which all places were seen, read or looked up. No unseen document stands above the place
after it, so the weighted impacts there add up to a bound on all unseen ones; the bound falls faster than that of the
last places read. An item is done when the bound lies strictly below its k-th score, since an equal score could still win
by its id, or when its lists end. What a task has found so far is where its next shard starts from; the k best of each
task are merged at the end. All scores are 64-bit integers.

Items come to the tasks by broadcast, in blocks of at most ``ITEM_BYTES`` of text (one item at least), with one pass over
the documents each.

Nulls: a null or empty text has no terms; a document without terms is not counted and is never found. Each row is a
document of its own, also if its id repeats; a null doc_id comes before others of the same score. Rows with one item_id
are one item with the terms of all of them (a null item_id is one, too). Items without terms, or whose terms no document
has, give no rows. Only the named columns are read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalspark.llm.common import slices
from evalspark.plans.shared import settle

K = 10
#: Text of query items that are searched for in one pass over the documents.
ITEM_BYTES = 8_000_000
#: Postings of a shard; a document is never cut.
POSTINGS = 1_000_000
SLICE = 2_000_000
#: Places read from each list at first; each further read is twice as deep.
DEPTH = 16

#: Letters A-Z become small; other ASCII characters that are no letters or digits separate terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other characters beyond ASCII, in order."""
    return (text or "").encode().translate(_BYTES).split()


@dataclass
class Block:
    """Query items by number: the numbers of their terms, which begin at 1."""

    vocabulary: dict[bytes, int]
    items: list[np.ndarray]

    @staticmethod
    def of(texts: Sequence[Sequence[str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        items = []
        for parts in texts:
            own = dict.fromkeys(t for text in parts for t in terms(text))
            items.append(np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in own], np.int64))
        return Block(vocabulary, items)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc: str, text: str) -> DataFrame:
    """``doc, n`` (terms with repeats), and ``terms`` (numbers, ascending) with ``tfs`` for those in the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in slices(batches, "text", SLICE):
            sizes, found, counts = [], [], []
            for value in batch.column("text").to_pylist():
                words = terms(value)
                own, times = np.unique(np.array(list(filter(None, map(number, words))), np.int32), return_counts=True)
                sizes.append(len(words))
                found.append(own)
                counts.append(times)
            lists = [pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of ``tf`` occurrences in documents of ``n`` terms."""
    if len(n) and 90 * int(n.max()) * documents >= 2**62:
        share = np.array([90 * int(x) * documents // length for x in n], np.int64)
    else:
        share = 90 * n * documents // max(1, length)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + share))


class Shard:
    """Impact lists of the terms in some documents, with direct access."""

    def __init__(self, owners: np.ndarray, numbers: np.ndarray, impact: np.ndarray, documents: int, vocabulary: int):
        """Postings ordered by (document, term): document from 0, term from 1, impact."""
        order = np.lexsort((owners, -impact, numbers))
        self.document, self.impact = owners[order], impact[order]
        self.begins = np.searchsorted(numbers[order], np.arange(vocabulary + 2))
        self.width = vocabulary + 1
        self.keys = owners * self.width + numbers
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.seen, self.known = np.zeros(len(order) + 1, bool), np.zeros(documents, bool)

    def look_up(self, documents: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Direct access: the places of documents (rows) in the lists of terms (columns), -1 where there is none."""
        wanted = documents[:, None] * self.width + numbers
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.place[at], -1)

    def best(self, numbers: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that hold the k best ones of this shard that score at least ``least``, ties included;
        and how many documents were looked up."""
        begin, end = self.begins[numbers], self.begins[numbers + 1]
        some = (begin < end) & (weights > 0)
        numbers, weights, begin, end = numbers[some], weights[some], begin[some], end[some]
        read, edge, depth = begin.copy(), begin.copy(), DEPTH
        documents, scores, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        while len(numbers):
            read = np.maximum(read, edge)  # what direct accesses saw need not be read
            upto = np.minimum(read + depth, end)
            new = np.unique(np.concatenate([self.document[a:b] for a, b in zip(read.tolist(), upto.tolist(), strict=True)]))
            new = new[~self.known[new]]
            read, depth = upto, 2 * depth
            if len(new):
                self.known[new] = True
                places = self.look_up(new, numbers)
                hit = places >= 0
                self.seen[places[hit]] = True
                marks.append(places[hit])
                documents.append(new)
                scores.append((np.where(hit, self.impact[places], 0) * weights).sum(axis=1))
            for k_list, (a, b) in enumerate(zip(edge.tolist(), end.tolist(), strict=True)):
                if a < b and self.seen[a]:
                    first = int(self.seen[a:b].argmin())
                    edge[k_list] = a + first if not self.seen[a + first] else b
            bound = int((np.where(edge < end, self.impact[np.minimum(edge, len(self.impact) - 1)], 0) * weights).sum())
            every = np.concatenate(scores)
            kth = int(np.partition(every, len(every) - k)[len(every) - k]) if len(every) >= k else 0
            if bound < max(kth, least, 1):
                break
        documents, scores = np.concatenate(documents), np.concatenate(scores)
        self.known[documents] = False
        for places in marks:
            self.seen[places] = False
        looked = len(documents)
        if len(scores) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            documents, scores = documents[keep], scores[keep]
        keep = scores >= max(least, 1)
        return documents[keep], scores[keep], looked


class Top:
    """The k best (score, document) of each item so far; equal scores by ascending document, null first."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]

    def least(self, item: int) -> int:
        scores = self.held[item][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, item: int, scores: np.ndarray, names: np.ndarray, known: np.ndarray) -> None:
        scores, names, known = (np.concatenate(x) for x in zip(self.held[item], (scores, names, known), strict=True))
        order = np.lexsort((names, known, -scores))[: self.k]
        self.held[item] = scores[order], names[order], known[order]


def _search(rows: DataFrame, block: Block, weights: np.ndarray, documents: int, length: int, k: int, size: int) -> DataFrame:
    """``number, doc, score``: the k best documents of each task for each item."""
    held = rows.sparkSession.sparkContext.broadcast((block.items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight_of = held.value
        top = Top(len(items), k)

        def shard(table: pa.Table) -> None:
            table = table.combine_chunks()
            lists, names = table.column("terms").combine_chunks(), table.column("doc").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            owners = np.repeat(np.arange(len(sizes)), sizes)
            numbers = lists.flatten().to_numpy().astype(np.int64)
            tf, n = table.column("tfs").combine_chunks().flatten().to_numpy(), np.repeat(table.column("n").to_numpy(), sizes)
            found = Shard(owners, numbers, impacts(tf, n, documents, length), len(sizes), len(weight_of) - 1)
            known, ids = names.is_valid().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
            for item, own in enumerate(items):
                best, scores, _ = found.best(own, weight_of[own], k, top.least(item))
                if len(best):
                    top.add(item, scores, ids[best], known[best])

        waiting, count = [], 0
        for batch in batches:
            step = max(1, size // 50)
            for begin in range(0, batch.num_rows, step):
                piece = batch.slice(begin, step)
                waiting.append(piece)
                count += len(piece.column("terms").flatten())
                if count >= size:
                    shard(pa.Table.from_batches(waiting))
                    waiting, count = [], 0
        if count:
            shard(pa.Table.from_batches(waiting))
        for item, (scores, names, known) in enumerate(top.held):
            if len(scores):
                columns = [pa.array(np.full(len(scores), item), pa.int64()), pa.array(names, pa.int64(), mask=~known), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["number", "doc", "score"])

    return rows.filter(F.size("terms") > 0).mapInArrow(run, "number long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc: str = "doc_id", item: str = "item_id", text: str = "text", postings_in_shard: int = POSTINGS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item, rank, doc, score``: the k highest-scoring rows of ``docs`` for each item, of score above 0."""
    spark = docs.sparkSession
    items = items.select(F.col(item).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    found = None
    for number in range(blocks):
        # At most about ITEM_BYTES of query texts, or one item.
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).groupBy("item").agg(F.collect_set("text").alias("texts"))
        rows = part.collect()
        block = Block.of([r["texts"] for r in rows])
        listed = settle(postings(docs, block.vocabulary, doc, text), "postings")
        totals = listed.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        counts = listed.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per query term
        weights = np.zeros(len(block.vocabulary) + 1, np.int64)
        for r in counts:
            weights[r["term"]] = weight(totals["documents"], r["count"])
        names = spark.createDataFrame([(n, r["item"]) for n, r in enumerate(rows)], T.StructType([T.StructField("number", T.LongType()), T.StructField("item", part.schema["item"].dataType)]))
        best = _search(listed, block, weights, totals["documents"], totals["length"], k, postings_in_shard).join(names, "number")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_first())
    ranked = settle(found, "best-of-tasks").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")
