"""Contingency cells that are kept up to date by signed deltas, instead of being counted anew.

A store is a folder. Each append has a number and brings predictions with their labels; a prediction may replace an
earlier one of its pair. The append writes its rows and, last, the change of the cells: 1 more for each new (label,
prediction), 1 less for each one that was replaced. Only the rows in the slots (hashes of run and artifact) that the append
touches are looked through for replaced ones, so the work follows the append and not the table. The sum of all changes is
the contingency table of the newest predictions, and all metrics come from it.

``compact`` sums the changes and keeps the newest row of each pair, as a new generation; a pointer to it is written when it
is whole. An append that is repeated under its number overwrites itself. Appends to one store run one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.metrics import KEYS
from evalspark.operators.scoring import PAIR_KEY
from evalspark.plans.shared import settle

SLOTS = 64
# Rows that one task sorts; the number of tasks follows from it.
ROWS_PER_TASK = 200_000
ROW = "run_id string, artifact_hash string, split string, id bigint, label string, prediction string"
CELL = "run_id string, artifact_hash string, split string, label string, prediction string, n bigint"
_CELL = (*KEYS, "label", "prediction")


def new_store(spark: SparkSession, path: str) -> None:
    """An empty store; one that exists stays as it is."""
    spark.createDataFrame([], f"{ROW}, slot int").write.mode("ignore").partitionBy("slot").parquet(f"{path}/rows/append=-1")
    spark.createDataFrame([], CELL).write.mode("ignore").parquet(f"{path}/cells/append=-1")
    spark.createDataFrame([(-1,)], "upto bigint").write.mode("ignore").parquet(f"{path}/pointer/compaction=-1")


def _generation(spark: SparkSession, path: str) -> int:
    """Number of the last append that the newest whole generation holds; -1 without one."""
    return spark.read.schema("upto bigint, compaction bigint").parquet(f"{path}/pointer").agg(F.max("upto")).first()[0]


def _parts(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows or cells of the newest generation and of the appends after it, with their ``append``."""
    upto = _generation(spark, path)
    later = spark.read.schema(f"{schema}, append bigint").parquet(f"{path}/{kind}").where(F.col("append") > upto)
    if upto < 0:
        return later
    return later.unionByName(spark.read.schema(schema).parquet(f"{path}/generation={upto}/{kind}").withColumn("append", F.lit(upto).cast("bigint")))


def _slot():
    return F.pmod(F.xxhash64("run_id", "artifact_hash"), F.lit(SLOTS).cast("bigint")).cast("int")


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Number of rows in each slot; SLOTS numbers at most."""
    return {r["slot"]: r["count"] for r in rows.groupBy("slot").count().collect()}


def _by_pair(rows: DataFrame, sizes: dict[int, int]) -> GroupedData:
    """Rows with their slot, grouped by pair in tasks of about ``ROWS_PER_TASK`` rows.

    The pairs of a slot are in as many parts as its rows need, so a task writes few slots and its memory does not follow the table.
    """
    parts = {slot: -(-n // ROWS_PER_TASK) for slot, n in sizes.items()}
    number = F.create_map(*[F.lit(x) for item in parts.items() for x in item])[F.col("slot")] if parts else F.lit(1)
    part = F.pmod(F.xxhash64("split", "id"), F.coalesce(number, F.lit(1)).cast("bigint"))
    # One key that always depends on the id: constant columns would fold away and change the partitioning.
    dealt = rows.withColumn("_task", F.col("slot") * F.lit(2**32) + part).repartition(max(1, sum(parts.values())), "_task")
    return dealt.groupBy("_task", "slot", *PAIR_KEY)


def _newest(rows: DataFrame) -> DataFrame:
    newest = _by_pair(rows, _sizes(rows)).agg(F.max_by(F.struct("label", "prediction"), "append").alias("v"))
    return newest.select(*PAIR_KEY, "v.label", "v.prediction", "slot")


def replaced_rows(rows: DataFrame, path: str, number: int, slots: Sequence[int]) -> DataFrame:
    """The newest earlier rows of the pairs of ``rows``; only files of ``slots`` are read.

    Both meet in one aggregation, as neither side need be small. A pair with a null key replaces nothing.
    """
    known = _parts(rows.sparkSession, path, "rows", f"{ROW}, slot int").where(F.col("slot").isin(list(slots)) & (F.col("append") < number))
    known = known.select("slot", *PAIR_KEY, F.struct("label", "prediction").alias("_old"), "append")
    asked = rows.dropna(subset=list(PAIR_KEY)).select(_slot().alias("slot"), *PAIR_KEY, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("_old", "append")])
    both = known.unionByName(asked)
    met = _by_pair(both, _sizes(both)).agg(F.max_by("_old", "append").alias("v"), F.bool_or(F.col("append").isNull()).alias("_asked"))
    return met.where(F.col("_asked") & F.col("v").isNotNull()).select(*PAIR_KEY, "v.label", "v.prediction")


def append_predictions(rows: DataFrame, path: str, number: int) -> DataFrame:
    """Append rows (``ROW``) under a number that follows all earlier ones; returns the change of the cells.

    Of several rows of one pair in ``rows`` the least label and prediction counts. ``rows`` are counted before they are read.
    """
    spark = rows.sparkSession
    if number <= _generation(spark, path):
        raise ValueError(f"append {number} is part of a generation already")
    rows = rows.withColumn("slot", _slot())
    sizes = _sizes(rows)
    fresh = _by_pair(rows, sizes).agg(F.min(F.struct("label", "prediction")).alias("v")).select(*PAIR_KEY, "v.label", "v.prediction", "slot")
    fresh.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/rows/append={number}")
    fresh = spark.read.schema(f"{ROW}, slot int").parquet(f"{path}/rows/append={number}")
    more = fresh.select(*_CELL, F.lit(1).alias("n"))
    less = replaced_rows(fresh, path, number, list(sizes)).select(*_CELL, F.lit(-1).alias("n"))
    change = more.unionByName(less).groupBy(*_CELL).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    change.write.mode("overwrite").parquet(f"{path}/cells/append={number}")
    return spark.read.schema(CELL).parquet(f"{path}/cells/append={number}")


def current_cells(spark: SparkSession, path: str) -> DataFrame:
    """The contingency cells of the newest predictions, as ``metrics.contingency`` would count them."""
    return _parts(spark, path, "cells", CELL).groupBy(*_CELL).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def current_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every pair."""
    return _newest(_parts(spark, path, "rows", f"{ROW}, slot int")).drop("slot")


def compact(spark: SparkSession, path: str) -> int:
    """Write a new generation of all appends so far, then the pointer to it; returns the last append in it."""
    last = spark.read.schema(f"{CELL}, append bigint").parquet(f"{path}/cells").agg(F.max("append")).first()[0]
    if last is None or last <= _generation(spark, path):
        return _generation(spark, path)
    folder = f"{path}/generation={last}"
    upto = F.col("append") <= last
    cells = settle(_parts(spark, path, "cells", CELL).where(upto).groupBy(*_CELL).agg(F.sum("n").alias("n")).where(F.col("n") != 0), "cells")
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    rows = _newest(_parts(spark, path, "rows", f"{ROW}, slot int").where(upto))
    rows.write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/rows")
    spark.createDataFrame([(last,)], "upto bigint").write.mode("overwrite").parquet(f"{path}/pointer/compaction={last}")
    return last
