"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.plans.session import ship_package
from evalspark.plans.shared import settle, tidy  # noqa: F401

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows handed to a Python worker at a time: whole texts can be long, and a worker holds a batch more than once.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep their batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys``, from a partition that is sorted by them. Keys are never null."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in pairwise(cuts):
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` items."""
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


@lru_cache(maxsize=2)
def load_tokenizer(content: str, special_as_text: bool):
    """A tokenizers library tokenizer, kept in the worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (strings or binaries) holds about ``limit`` bytes in each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if row > begin and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        yield batch.slice(begin)


class Places(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = place = len(self)
        return place


class PartStore:
    """Ids of parts of texts that were encoded before, one flat array with a place for each part.

    A store belongs to one worker process. It is emptied when it is full, which changes no result.
    """

    def __init__(self, encode: Callable[[list], list[list[int]]], limit: int):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self) -> None:
        self.places: dict = Places()
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, parts: list, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and the number of ids of each part; with ``order``, of the parts that it names in its order."""
        kept = len(self.places)
        places = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        if kept and len(self.places) > max(kept, self.limit):
            self._empty()
            return self.ids(parts, order)
        if new := list(islice(self.places, kept, None)):
            found = self.encode(new)
            sizes = np.array([len(f) for f in found], np.int64)
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))))
        if order is not None:
            places = places.take(order)
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begins[places] - ends + sizes, sizes) + np.arange(total)], sizes


def numbered(rows: DataFrame, group: list[str], order: list[str], number: str, count: str | None = None) -> DataFrame:
    """Adds the place of a row in its group, from 0, and the size of the group; a written table.

    Rows of equal ``order`` are spread by their place in the source, so a repeated row does not fill one partition.
    """
    rows = rows.withColumn("_spread", F.monotonically_increasing_id())
    by = [*(F.col(c).asc_nulls_first() for c in (*group, *order)), F.col("_spread")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread")
    ranged = settle(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered-rows")
    # One row per group and range that it touches.
    part = F.shiftright("_at", 33).alias("_part")
    spans = ranged.groupBy(*group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_whole"),
    )
    spans = settle(spans, "order-spans")
    same = F.shiftright("_at", 33) == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = ranged.join(spans, same)
    added = [(F.col("_at") - F.col("_first") + F.col("_before")).alias(number)]
    if count:
        added.append(F.col("_whole").alias(count))
    return settle(joined.select(*[c for c in ranged.columns if c != "_at"], *added), "numbered-rows")


def identified(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """``row``, a number that no two rows share, and ``d``, the row's columns.

    Where ``name`` is never null and never repeats it is the number; else rows are numbered in its order, null last.
    """
    packed = docs.select(F.col(name).cast("long").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    shared = packed.groupBy("row").count().filter((F.col("count") > 1) | F.col("row").isNull())
    if shared.isEmpty():
        return packed
    placed = numbered(packed.withColumn("none", F.col("row").isNull()), [], ["none", "row"], "number")
    return placed.select(F.col("number").alias("row"), "d")


def running_sum(
    df: DataFrame, groups: list[str], order: list[str], value: str, out: str, block: Column, name: str = "_block"
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, without sorting a group in one task.

    ``block`` maps rows to blocks that ascend with ``order`` (for instance the leading bits of a hash that ``order``
    begins with). Rows are summed per block, blocks are accumulated per group, and only the rows of one block are
    sorted together.
    """
    df = df.withColumn(name, block)
    totals = df.groupBy(*groups, name).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*groups).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col(name).alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*groups, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(name) == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, same)
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop(name, "_b", "_start", "_inside", *[f"_g_{g}" for g in groups])
    )
