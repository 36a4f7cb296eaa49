"""Snapshots of the log with digests, so that two of them are compared where they differ only.

A snapshot is stored by run and block of iterations. Each block has a digest that does not depend on the order of its rows:
their number and the sums of the halves of two 64-bit hashes of each row. Sums of blocks are the digest of the run, and
those of an append are added to the ones before. A check compares the digests of runs, then of the blocks of runs that
differ, and reads rows of the blocks that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.keys import join_on
from evalspark.plans.shared import settle
from evalspark.sources.jsonl import log_rewrites

BLOCK = 1024
SPOT = ("run_id", "block")
_SUMS = ("rows", "low_1", "high_1", "low_2", "high_2")


def _block(size: int) -> Column:
    return F.floor(F.col("iter") / F.lit(size)).cast("bigint").alias("block")


def block_digests(log: DataFrame, size: int = BLOCK) -> DataFrame:
    """``run_id, block`` and the digest of the block's rows; copies of a row count."""
    text = F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false"})
    hashed = log.select("run_id", _block(size), F.xxhash64(text, F.lit(1)).alias("_1"), F.xxhash64(text, F.lit(2)).alias("_2"))
    halves = [f(F.col(f"_{k}")).alias(f"{n}_{k}") for k in (1, 2) for n, f in (("low", lambda h: F.sum(h.bitwiseAND(0xFFFFFFFF))), ("high", lambda h: F.sum(F.shiftrightunsigned(h, 32))))]
    return hashed.groupBy(*SPOT).agg(F.count(F.lit(1)).alias("rows"), *halves)


def added(digests: DataFrame) -> DataFrame:
    """One row per block from the digests of several appends."""
    return digests.groupBy(*SPOT).agg(*[F.sum(c).alias(c) for c in _SUMS])


def run_digests(digests: DataFrame) -> DataFrame:
    return digests.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _differ(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of ``old`` whose digest is another one in ``new``, or is not there."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in _SUMS])
    same = F.lit(True)
    for c in _SUMS:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return join_on(old, renamed, keys, "left").where(~F.coalesce(same, F.lit(False))).select(*keys)


def changed_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """``run_id, block`` of the blocks of the older snapshot that are not the same in the newer one, from their digests."""
    runs = settle(_differ(run_digests(old), run_digests(new), ("run_id",)), "changed-runs")
    return _differ(*[join_on(d, runs, ["run_id"], "left_semi") for d in (old, new)], SPOT)


def write_snapshot(log: DataFrame, path: str, size: int = BLOCK) -> None:
    """Store the log by run and block, then its digests beside it. Two snapshots that are compared have one block size."""
    log.withColumn("block", _block(size)).write.partitionBy(*SPOT).parquet(path)
    block_digests(read_snapshot(log.sparkSession, path, log).drop("block"), size).write.parquet(f"{path.rstrip('/')}-digests")


def read_snapshot(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """A stored snapshot with the columns of ``log`` and its ``block``."""
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in log.schema)}, block bigint").parquet(path)
    return rows.select(*log.columns, "block")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}-digests")


def rows_to_compare(spark: SparkSession, path: str, log: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of a snapshot in some blocks; folders of other blocks are pruned."""
    return join_on(read_snapshot(spark, path, log), blocks, SPOT, "left_semi").select(*log.columns)


def snapshot_rewrites(spark: SparkSession, old: str, new: str, log: DataFrame) -> DataFrame:
    """``log_rewrites`` of two stored snapshots with the columns of ``log``: only blocks that differ are read."""
    blocks = settle(changed_blocks(read_digests(spark, old), read_digests(spark, new)), "changed-blocks")
    return log_rewrites(*[rows_to_compare(spark, path, log, blocks) for path in (old, new)])
