"""Sampling and splitting of labelled examples.

All choices follow a seeded hash of the row's identity (``order_key``), so a split is the same
whatever the partitioning or row order, and the exact operators never sort a stratum in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.hashing import hash8, order_key
from evalspark.functions.numbers import ratio
from evalspark.operators.keys import join_on
from evalspark.operators.ranking import prefix_histogram, rank_cutoffs
from evalspark.plans.shared import settle


def subsample(df: DataFrame, limit: int, identity: Sequence[str] = ("id",), seed: int = fixed.SEED) -> DataFrame:
    """Exactly ``min(limit, rows)`` rows: those with the smallest order keys.

    The key at rank ``limit`` is found first (a histogram and one narrow prefix of the keys), then
    the rows are filtered by it; no task ever holds the sample.
    """
    if limit <= 0:
        return df.where(F.lit(False))
    keyed = df.withColumn("_key", order_key(*identity, seed=seed)).withColumn("_all", F.lit(0))
    histogram = prefix_histogram(keyed, ["_all"], "_key")
    if (histogram.agg(F.sum("_n")).first()[0] or 0) <= limit:
        return df
    cuts = df.sparkSession.range(1).select(
        F.lit(0).alias("_all"), F.lit("sample").alias("cut"), F.lit(limit).cast("bigint").alias("rank")
    )
    last = rank_cutoffs(keyed, ["_all"], "_key", cuts, histogram).first()["key"]
    return keyed.where(F.col("_key") <= F.lit(last)).drop("_key", "_all")


def _allocate(counts: DataFrame, by: Sequence[str], stratum: str, size: str, total: str, name: str) -> DataFrame:
    """Share ``total`` out over strata in proportion to ``size`` by largest remainder.

    Integers throughout; equal remainders go to the larger stratum, then to the first name. One
    row per stratum, so the windows are as small as the list of strata.
    """
    whole = Window.partitionBy(*by)
    shared = (
        counts.withColumn("_sum", F.sum(size).over(whole).cast("decimal(19,0)"))
        .withColumn("_product", F.col(size).cast("decimal(19,0)") * F.col(total).cast("decimal(19,0)"))
        .withColumn("_base", F.expr("if(_sum = 0, 0, _product div _sum)").cast("bigint"))
        .withColumn("_rest", F.expr("if(_sum = 0, 0, _product % _sum)"))
        .withColumn("_left", F.col(total) - F.sum("_base").over(whole))
    )
    turn = whole.orderBy(F.desc("_rest"), F.desc(size), F.asc(stratum))
    extra = F.when(F.row_number().over(turn) <= F.col("_left"), 1).otherwise(0)
    return shared.withColumn(name, F.col("_base") + extra).drop("_sum", "_product", "_base", "_rest", "_left")


def split_quotas(
    counts: DataFrame,
    by: Sequence[str],
    stratum: str,
    train: int = fixed.TRAIN_PERMILLE,
    dev: int = fixed.DEV_PERMILLE,
    test: int = fixed.TEST_PERMILLE,
) -> DataFrame:
    """Rows of every stratum that go to each split, from stratum sizes (``by``, stratum, ``n``).

    The test set takes ceil(test share) of a dataset and the dev set ceil(dev / (train + dev)) of
    what is left. What is *kept* at each step is shared out over the strata by largest remainder.
    """
    whole = Window.partitionBy(*by)
    sized = (
        counts.withColumn("_rows", F.sum("n").over(whole))
        .withColumn("_test", F.expr(f"(_rows * {test} + {train + dev + test - 1}) div {train + dev + test}"))
        .withColumn("_kept", F.col("_rows") - F.col("_test"))
        .withColumn("_dev", F.expr(f"(_kept * {dev} + {train + dev - 1}) div {train + dev}"))
        .withColumn("_train", F.col("_kept") - F.col("_dev"))
    )
    kept = _allocate(sized, by, stratum, "n", "_kept", "kept")
    final = _allocate(kept, by, stratum, "kept", "_train", "train")
    return final.select(
        *by, stratum, "n", "train",
        (F.col("kept") - F.col("train")).alias("dev"),
        (F.col("n") - F.col("kept")).alias("test"),
    )


def stratified_split(
    df: DataFrame,
    stratum: str = "domain",
    by: Sequence[str] = (),
    identity: Sequence[str] = ("id",),
    seed: int = fixed.SEED,
    train: int = fixed.TRAIN_PERMILLE,
    dev: int = fixed.DEV_PERMILLE,
    test: int = fixed.TEST_PERMILLE,
) -> DataFrame:
    """Add ``split`` with exact, proportional sizes per stratum; ``identity`` must be unique.

    In a stratum the rows with the smallest order keys are the test set, the next ones dev, the
    rest train. Only the two keys at the borders are looked up (see ``rank_cutoffs``); the rows
    themselves are labelled by comparing their key with the borders of their stratum, a join with
    one row per stratum. A stratum holding most of the rows costs the same as any other.
    """
    groups = ["_all", *by, stratum]
    keyed = df.withColumn("_key", order_key(*identity, seed=seed)).withColumn("_all", F.lit(0))
    histogram = prefix_histogram(keyed, groups, "_key")
    counts = histogram.groupBy(*groups).agg(F.sum("_n").alias("n"))
    quotas = split_quotas(counts, ["_all", *by], stratum, train, dev, test)
    return _labelled(keyed, groups, quotas, histogram).select(*df.columns, "split")


def _labelled(keyed: DataFrame, groups: Sequence[str], quotas: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add ``split`` by the order of ``_key``: in each group ``test`` rows, then ``dev`` rows, then the rest."""
    cuts = quotas.select(
        *groups,
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("test").alias("rank")),
                F.struct(F.lit("dev").alias("cut"), (F.col("test") + F.col("dev")).alias("rank")),
            )
        ).alias("c"),
    ).select(*groups, "c.cut", "c.rank")
    cutoffs = rank_cutoffs(keyed, groups, "_key", cuts, histogram)
    borders = settle(
        cutoffs.groupBy(*groups).agg(
            F.max(F.when(F.col("cut") == "test", F.col("key"))).alias("_last_test"),
            F.max(F.when(F.col("cut") == "dev", F.col("key"))).alias("_last_dev"),
        ),
        "split-borders",
    )
    split = (
        F.when(F.col("_key") <= F.col("_last_test"), "test")
        .when(F.col("_key") <= F.col("_last_dev"), "dev")
        .otherwise("train")
    )
    return join_on(keyed, borders, groups, "left", null_safe=True).withColumn("split", split)


def _targets(counts: DataFrame, by: Sequence[str], stratum: str, train: int, dev: int, test: int) -> DataFrame:
    """``by``, stratum, ``split``, ``target``: the quotas of sizes ``n``, one row per split."""
    quotas = split_quotas(counts, by, stratum, train, dev, test)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("target")) for s in fixed.SPLITS]))
    return quotas.select(*by, stratum, each.alias("q")).select(*by, stratum, "q.*")


def grow_split(
    published: DataFrame,
    fresh: DataFrame,
    stratum: str = "domain",
    by: Sequence[str] = (),
    identity: Sequence[str] = ("id",),
    seed: int = fixed.SEED,
    train: int = fixed.TRAIN_PERMILLE,
    dev: int = fixed.DEV_PERMILLE,
    test: int = fixed.TEST_PERMILLE,
) -> DataFrame:
    """Add ``split`` to ``fresh`` rows that join a ``published`` split, of which no row moves.

    The quotas of old and new rows together say how many rows every split of a stratum lacks. Where
    the new rows are as many, each split gets what it lacks, and the sizes are those of a split made
    anew; where a split has more than its quota already, the new rows are shared among the others in
    proportion to what they lack, by largest remainder (``split_drift`` reports what is left). New
    rows are dealt out in the order of their keys, so neither their order nor their partitions matter.
    """
    groups = ["_all", *by, stratum]
    keyed = fresh.withColumn("_key", order_key(*identity, seed=seed)).withColumn("_all", F.lit(0))
    histogram = prefix_histogram(keyed, groups, "_key")
    new = histogram.groupBy(*groups).agg(F.sum("_n").alias("_new"))
    old = published.withColumn("_all", F.lit(0)).groupBy(*groups, "split").agg(F.count(F.lit(1)).alias("_old"))
    old = settle(old, "published-sizes")
    both = new.select(*groups, F.col("_new").alias("n")).unionByName(old.select(*groups, F.col("_old").alias("n")))
    targets = _targets(both.groupBy(*groups).agg(F.sum("n").alias("n")), ["_all", *by], stratum, train, dev, test)
    lacking = join_on(join_on(targets, old, [*groups, "split"], "left", null_safe=True), new, groups, null_safe=True).withColumn(
        "_lack", F.greatest(F.col("target") - F.coalesce("_old", F.lit(0)), F.lit(0).cast("bigint"))
    )
    shared = _allocate(lacking, groups, "split", "_lack", "_new", "_given")
    given = lambda split: F.sum(F.when(F.col("split") == split, F.col("_given")).otherwise(0)).alias(split)
    quotas = settle(shared.groupBy(*groups).agg(given("test"), given("dev")), "grown-quotas")
    return _labelled(keyed, groups, quotas, histogram).select(*fresh.columns, "split")


def split_drift(
    df: DataFrame,
    stratum: str = "domain",
    by: Sequence[str] = (),
    train: int = fixed.TRAIN_PERMILLE,
    dev: int = fixed.DEV_PERMILLE,
    test: int = fixed.TEST_PERMILLE,
) -> DataFrame:
    """``n``, ``target`` and ``drift`` of every split of a stratum: what it has, and what a split made anew would have."""
    groups = ["_all", *by, stratum]
    sizes = df.withColumn("_all", F.lit(0)).groupBy(*groups, "split").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*groups).agg(F.sum("n").alias("n"))
    have = join_on(_targets(whole, ["_all", *by], stratum, train, dev, test), sizes, [*groups, "split"], "left", null_safe=True)
    n = F.coalesce("n", F.lit(0))
    return have.select(*by, stratum, "split", n.alias("n"), "target", (n - F.col("target")).alias("drift"))


def hash_split(
    df: DataFrame,
    identity: Sequence[str] = ("id",),
    seed: int = fixed.SEED,
    train_tenths: int = 4,
    dev_tenths: int = 2,
) -> DataFrame:
    """Add ``split`` row by row, without a shuffle; sizes are approximate, members are stable."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])
    tenth = hash8(text) % 10
    return df.withColumn(
        "split",
        F.when(tenth < train_tenths, "train").when(tenth < train_tenths + dev_tenths, "dev").otherwise("test"),
    )


def split_statistics(df: DataFrame, stratum: str = "domain", by: Sequence[str] = ()) -> DataFrame:
    """Rows and share of every stratum in every split and ``overall``.

    ``split_rows`` counts all rows of the split; shares leave rows without a stratum out.
    """
    counts = df.groupBy(*by, "split", stratum).agg(F.count(F.lit(1)).alias("n"))
    levels = (
        counts.withColumn("split", F.explode(F.array(F.col("split"), F.lit("overall"))))
        .groupBy(*by, "split", stratum)
        .agg(F.sum("n").alias("n"))
    )
    whole = Window.partitionBy(*by, "split")
    known = F.sum(F.when(F.col(stratum).isNotNull(), F.col("n"))).over(whole)
    return (
        levels.withColumn("split_rows", F.sum("n").over(whole))
        .withColumn("share", ratio(F.col("n"), known))
        .where(F.col(stratum).isNotNull())
        .select(*by, "split", stratum, "n", "split_rows", "share")
    )


def split_balance(df: DataFrame, stratum: str = "domain", by: Sequence[str] = ()) -> DataFrame:
    """Per split, the largest distance of a stratum's share from its overall share."""
    stats = split_statistics(df, stratum, by)
    overall = stats.where(F.col("split") == "overall").select(
        *by, stratum, F.col("share").alias("_overall"),
        F.explode(F.array(*[F.lit(s) for s in fixed.SPLITS])).alias("split"),
    )
    shares = stats.where(F.col("split") != "overall").select(*by, stratum, "split", "share")
    gaps = join_on(overall, shares, [*by, stratum, "split"], "left", null_safe=True)
    return gaps.groupBy(*by, "split").agg(
        F.max(F.abs(F.coalesce(F.col("share"), F.lit(0.0)) - F.col("_overall"))).alias("largest_gap")
    )


def rare_strata(df: DataFrame, stratum: str = "domain", by: Sequence[str] = (), minimum: int = 2) -> DataFrame:
    """Strata with fewer rows than a two-step stratified split needs."""
    return df.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum)


def dataset_gates(examples: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Size gates: number of examples, and bytes of the largest artifact."""
    rows = examples.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("examples").alias("gate"),
        "value",
        F.when(F.col("value") < fixed.EXAMPLES_MINIMUM, "too few")
        .when(F.col("value") < fixed.EXAMPLES_WANTED, "few")
        .otherwise("ok")
        .alias("status"),
    )
    sizes = artifacts.agg(
        F.coalesce(F.max(F.octet_length("artifact")), F.lit(0)).cast("bigint").alias("value")
    ).select(
        F.lit("artifact_bytes").alias("gate"),
        "value",
        F.when(F.col("value") < fixed.ARTIFACT_MAX_BYTES, "ok").otherwise("too large").alias("status"),
    )
    return rows.unionByName(sizes)
