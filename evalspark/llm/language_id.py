"""Language identification by language-bitmask n-gram filters.

Learning counts the character n-grams (orders 2 to 4, of words with a space at either end) of all labelled texts, per
language. An n-gram belongs to a language if it makes up at least ``MIN_RATE`` of the language's n-grams, and at least
``CONTRAST`` of its rate in the language where it is most frequent; so foreign lines in a text, or a language with far
more text than the others, do not make n-grams of one language members of another. The members of all languages go into
one bit-sliced Bloom filter: each cell is a bitmask with one bit per language, an n-gram sets its languages' bits in
``HASHES`` cells, and the AND of these cells gives all languages that contain it at once. At most 1 / ``MIN_RATE``
n-grams belong to a language, so the filter has a bounded size, whatever the corpus.

A text is decided by per-language popcounts: how many of its n-grams a language contains, less the hits that chance gives.
Of n n-grams, a filter with the false-positive rate f (the share of the language's bits that are set, to the power of the
number of hashes) holds about h = t + (n - t) f where t truly belong, so t = (h - n f) / (1 - f). The language with the
most wins; the score is its share of the n-grams. Equal ones go to the language with more text, then to the first name.

Words are runs of letters (Unicode category L), in small letters; n-grams are hashed from the code points of whole texts
at once, in parts of ``CHARACTERS`` that overlap, so texts can be of any length. Nulls: a text that is null or has no letter is ``und`` with score 0; so is every text if no
labelled text has a letter. Rows with a null language teach nothing. Repeated rows count and are predicted one by one.
Columns other than the named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import slices
from evalspark.plans.shared import settle

UNDETERMINED = "und"
ORDERS = (2, 3, 4)
MIN_RATE = 2e-5
CONTRAST = 0.1
HASHES = 3
#: Cells per n-gram in the filter, at least.
CELLS = 16
#: Tokens that are counted before they are handed on.
COUNTED = 200_000
#: Characters that are hashed at a time, and bytes of text read for it.
CHARACTERS = SLICE = 500_000
_TURN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def words(token: str) -> list[str]:
    """Runs of letters in a token."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_grams(lines: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where n-grams begin in a small-lettered text, and their hashes, part by part.

    An n-gram is n characters of a word with what is before and after it, which counts as a space, whatever it is. So the
    text has to begin and end with a character that is no letter.
    """
    longest = max(ORDERS)
    for begin in range(0, len(lines), CHARACTERS):
        codes = np.frombuffer(lines[begin : begin + CHARACTERS + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
        hashes = codes
        for n in range(2, longest + 1):
            hashes = hashes[:-1] * _TURN + codes[n - 1 :]
            if n in ORDERS and len(hashes):
                # Letters but for the ends; of two characters, at least one.
                inner = [letter[k : len(letter) - n + 1 + k] for k in range(1, n - 1)]
                valid = np.logical_and.reduce(inner) if inner else letter[:-1] | letter[1:]
                places = np.flatnonzero(valid[:CHARACTERS])
                yield begin + places, _mixed(hashes[places] + np.uint64(n))


def joined(texts: list[str]) -> tuple[str, np.ndarray]:
    """Small-lettered texts as lines, and where each (with the line end before it) begins; one entry more than texts."""
    low = [t.lower() for t in texts]
    return "\n" + "".join(t + "\n" for t in low), np.cumsum([0, *(len(t) + 1 for t in low)])


def third() -> Column:
    """0 to 2 from the document's id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` of all texts; each task counts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                own = Counter()
                for token, n in found.items():
                    for word in words(token):
                        own[word] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in slices(batches, "text", SLICE):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update((text or "").lower().split())
            if sum(map(len, held.values())) > COUNTED:
                yield from counted()
        yield from counted()

    found = rows.filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """``lang, gram, n``: the n-grams of counted words, as 64-bit hashes."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        languages = table.column("lang").to_numpy(zero_copy_only=False)
        for lang in sorted(set(languages)):
            own = table.filter(pa.array(languages == lang))
            lines, begins = joined(own.column("word").to_pylist())
            times = own.column("n").to_numpy()
            for places, hashes in n_grams(lines):
                weights = times[np.searchsorted(begins, places, side="right") - 1]
                grams, at = np.unique(hashes, return_inverse=True)
                sums = np.bincount(at, weights, minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "word", SLICE):
            held.append(batch)
            size += batch.column("word").nbytes
            if size >= SLICE:
                yield from counted(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from counted(pa.Table.from_batches(held))

    return counts.select("lang", "word", "n").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64), (hashes >> np.uint64(32) | np.uint64(1)).astype(np.int64)


def _cell(first: np.ndarray, step: np.ndarray, turn: int, size: int) -> np.ndarray:
    """The cells that the turn-th hash of n-grams gives in a filter of ``size`` cells, a power of two."""
    return (first + step * turn) & (size - 1)


def _cells(gram: Column, size: int) -> Column:
    first, step = gram.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[(first + step * k).bitwiseAND(F.lit(size - 1).cast("long")) for k in range(HASHES)])


@dataclass
class Filters:
    """Languages in the order of their bits, and the cells: rows of 64 languages, one column per cell."""

    languages: list[str]
    #: Places of languages from the one with most text to the one with least.
    preferred: list[int]
    cells: np.ndarray

    def chance(self) -> np.ndarray:
        """False-positive rate of each language."""
        bits = [(self.cells[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(bits) ** HASHES

    def hits(self, texts: list[str]) -> np.ndarray:
        """For each text: how many of its n-grams each language contains, and, last, how many it has."""
        lines, begins = joined(texts)
        out = np.zeros((len(texts), len(self.languages) + 1), np.int64)
        small = np.min_scalar_type((1 << min(64, len(self.languages))) - 1)
        rows = [row.astype(small) if len(self.cells) == 1 else row for row in self.cells]
        for places, hashes in n_grams(lines):
            edges = np.searchsorted(places, begins)
            out[:, -1] += np.diff(edges)
            first, step = _halves(hashes)
            masks = [row[_cell(first, step, 0, len(row))] for row in rows]
            for turn in range(1, HASHES):
                at = _cell(first, step, turn, len(rows[0]))
                masks = [mask & row[at] for mask, row in zip(masks, rows, strict=True)]
            for k in range(len(self.languages)):
                bits = masks[k // 64] >> masks[0].dtype.type(k % 64) & masks[0].dtype.type(1)
                out[:, k] += np.diff(np.concatenate(([0], np.cumsum(bits, dtype=np.int32)))[edges])
        return out

    def decide(self, hits: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language (-1: undetermined) and score of each row of summed hits."""
        n = hits[:, -1]
        if not self.languages:
            return np.full(len(hits), -1), np.zeros(len(hits))
        true = np.clip((hits[:, :-1] - n[:, None] * chance) / np.maximum(1 - chance, 1e-9), 0, n[:, None])
        best = np.array(self.preferred)[true[:, self.preferred].argmax(axis=1)]
        score = true[np.arange(len(hits)), best] / np.maximum(n, 1)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)

    def predict(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns ``keep`` with ``lang_pred`` and ``score``."""
        held = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            chance, names = model.chance(), [*model.languages, UNDETERMINED]
            for batch in slices(batches, "_text", SLICE):
                best, score = model.decide(model.hits([t or "" for t in batch.column("_text").to_pylist()]), chance)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([names[k] for k in best], pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

        kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
        return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def learn(spark: SparkSession, rows: DataFrame, min_rate: float = MIN_RATE, contrast: float = CONTRAST) -> Filters:
    """Filters from all rows (``text``, ``lang``)."""
    grams = settle(gram_counts(word_counts(rows)), "n-grams")
    sizes = grams.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # one row per language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Filters([], [], np.zeros((1, 1), np.uint64))
    totals = settle(spark.createDataFrame([(r["lang"], k, r["total"]) for k, r in enumerate(sizes)], "lang string, place int, total long"), "languages")
    rates = grams.join(totals, "lang").select("gram", "place", (F.col("n") / F.col("total")).alias("rate"))
    # One entry per language at most.
    together = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("place", "rate")).alias("at"))
    belongs = F.filter("at", lambda a: (a["rate"] >= min_rate) & (a["rate"] >= contrast * F.col("top")))
    members = settle(together.select("gram", F.transform(belongs, lambda a: a["place"]).alias("places")).filter(F.size("places") > 0), "member-n-grams")
    size = 1 << max(10, (CELLS * members.count() - 1).bit_length())
    bit = F.expr("shiftleft(1L, _place % 64)")
    cells = members.select(F.explode("places").alias("_place"), "gram").select("_place", F.explode(_cells(F.col("gram"), size)).alias("cell"))
    found = cells.groupBy("cell", F.expr("_place div 64").alias("row")).agg(F.bit_or(bit).alias("mask")).toArrow()  # at most the filter's cells
    filled = np.zeros((-(-len(languages) // 64), size), np.uint64)
    filled[found.column("row").to_numpy(), found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    preferred = sorted(range(len(sizes)), key=lambda k: (-sizes[k]["total"], languages[k]))
    return Filters(languages, preferred, filled)
