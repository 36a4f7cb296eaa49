"""A bitmap ledger of the prediction cache: which pairs have an answer, one bit each.

A row holds 32,768 examples of one artifact and split: ``run_id, artifact_hash, split, bucket, bits``, bucket and bit
following from the example's id. Whether an artifact is finished, and how many of its pairs are cached, is found by
uniting and counting bitmaps; pairs become rows only where bits are missing. Bitmaps of several appends are united when
they are read, in any order and any number of times, so an append that is repeated changes nothing.

Ids should be dense: a bitmap takes 4 KB (before compression) however few examples of its bucket there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.keys import join_on
from evalspark.plans.shared import settle

LEDGER_KEY = ("run_id", "artifact_hash", "split", "bucket")
_SPOT = ("run_id", "split", "bucket")


def _bucket() -> Column:
    return F.bitmap_bucket_number("id").alias("bucket")


def _bits() -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position("id"))


def ledger_of(cache: DataFrame) -> DataFrame:
    """The ledger of cached rows; copies of a row set the same bit."""
    keyed = cache.where(F.col("id").isNotNull())
    return keyed.groupBy("run_id", "artifact_hash", "split", _bucket()).agg(_bits().alias("bits"))


def united(ledger: DataFrame) -> DataFrame:
    """One row per key from the rows of several appends."""
    return ledger.groupBy(*LEDGER_KEY).agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_is_set(bits: Column, number: Column) -> Column:
    """Whether a bitmap (null: empty) has the bit of an id."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1, F.lit(False))


def ledger_state(artifacts: DataFrame, examples: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every wanted bitmap of every artifact: ``LEDGER_KEY, wanted, cached`` (numbers of bits) and ``bits`` (those set).

    The wanted bits of a run stand once and meet its artifacts in a join on the run; they are united with the ledger's in
    one aggregation, whose rows are as many as bitmaps. ``ledger`` may hold several rows per key.
    """
    names = artifacts.select("run_id", "artifact_hash").distinct()
    lines = examples.where(F.col("id").isNotNull())
    wanted = settle(lines.groupBy("run_id", "split", _bucket()).agg(_bits().alias("bits")), "wanted-bits")
    asked = join_on(names, wanted, ["run_id"]).select(*LEDGER_KEY, "bits", F.lit(True).alias("_asked"))
    known = join_on(ledger, names, ["run_id", "artifact_hash"], "left_semi").select(*LEDGER_KEY, "bits", F.lit(False).alias("_asked"))
    side = lambda asked: F.bitmap_or_agg(F.when(F.col("_asked") == asked, F.col("bits")))
    both = asked.unionByName(known).groupBy(*LEDGER_KEY).agg(
        F.bitmap_count(side(True)).alias("wanted"), side(False).alias("bits"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("_all")
    )
    cached = F.bitmap_count("bits") + F.col("wanted") - F.col("_all")
    return both.where(F.col("wanted") > 0).select(*LEDGER_KEY, "wanted", cached.alias("cached"), "bits")


def unset_pairs(artifacts: DataFrame, examples: DataFrame, ledger: DataFrame) -> DataFrame:
    """``run_id, artifact_hash, split, id`` of the pairs whose bit is missing; finished bitmaps make no rows."""
    unfinished = ledger_state(artifacts, examples, ledger).where(F.col("cached") < F.col("wanted")).select(*LEDGER_KEY, "bits")
    unfinished = settle(unfinished, "unfinished-bits")
    lines = examples.where(F.col("id").isNotNull()).select("run_id", "split", "id", _bucket())
    # The test is part of the join's condition, so no pair carries a bitmap.
    same = [lines[c] == unfinished[c] for c in _SPOT]
    found = lines.join(unfinished, [*same, ~bit_is_set(unfinished["bits"], lines["id"])])
    return found.select(lines["run_id"], "artifact_hash", lines["split"], "id")


def hit_rate(artifacts: DataFrame, examples: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs, cached pairs and their share, per run; a pair counts once."""
    state = ledger_state(artifacts, examples, ledger).groupBy("run_id").agg(F.sum("wanted").alias("pairs"), F.sum("cached").alias("hits"))
    return state.withColumn("hit_rate", F.col("hits") / F.col("pairs"))
