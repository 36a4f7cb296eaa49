"""Artifacts: texts identified by their content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.hashing import sha16
from evalspark.operators.keys import join_on


def with_artifact_hash(df: DataFrame, text: str = "artifact") -> DataFrame:
    return df.withColumn("artifact_hash", sha16(text))


def dedupe_artifacts(artifacts: DataFrame, by: Sequence[str] = ("run_id",), order: str = "iter") -> DataFrame:
    """The first row of every content hash; of rows at the same position the first by content.

    The first position per hash is a partial aggregation, so a text proposed over and over is
    reduced before the shuffle; the full rows are then looked up by (hash, position).
    """
    keys = [*by, "artifact_hash"]
    first = artifacts.groupBy(*keys).agg(F.min(order).alias(order))
    # Only rows that tie at the first position are left to be ranked.
    tied = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*artifacts.columns)))
    rows = join_on(artifacts, first, [*keys, order], "left_semi").withColumn("_tie", F.row_number().over(tied))
    return rows.where(F.col("_tie") == 1).select(*artifacts.columns)


def selector_view(log: DataFrame) -> DataFrame:
    """The log without anything measured on the test set."""
    return log.drop(*[c for c in log.columns if c.endswith("_test")])
