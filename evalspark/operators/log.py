"""Analytics of the experiment log.

The log has one row per run and iteration (``run_id, iter`` is its key) with wide metric columns.
Best entries, winners and summaries are aggregations with partial results; top-k filters are
limited before the shuffle; running values use ``ranking.running``. No operator puts the log of a
run into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.numbers import fixed3, or_zero, ratio
from evalspark.functions.text import shorten
from evalspark.operators.keys import join_on
from evalspark.operators.ranking import place, running
from evalspark.plans.shared import settle

ENTRY = ("run_id", "iter")


def _gap() -> Column:
    return or_zero("kappa_dev") - or_zero("kappa_test")


def _best_iter() -> Column:
    """Iteration with the best dev kappa; a missing kappa counts as 0, the first one wins ties."""
    return (-F.max(F.struct(or_zero("kappa_dev").alias("kappa"), (-F.col("iter")).alias("back")))["back"]).alias("iter")


# Lookups -------------------------------------------------------------------------------------


def entry_by_iter(log: DataFrame, iteration: int) -> DataFrame:
    return log.where(F.col("iter") == iteration)


def entries_by_batch(log: DataFrame, batch: int) -> DataFrame:
    return log.where(F.col("batch") == batch)


def log_as_of(log: DataFrame, iteration: int) -> DataFrame:
    """The log as it stood after an iteration."""
    return log.where(F.col("iter") <= iteration)


def best_entry(log: DataFrame) -> DataFrame:
    """The best entry of every run."""
    return join_on(log, log.groupBy("run_id").agg(_best_iter()), ENTRY, "left_semi")


def log_position(log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Last iteration and last batch per run; 0 for a run of ``runs`` without entries."""
    last = log.groupBy("run_id").agg(F.max("iter").alias("last_iter"), F.max("batch").alias("last_batch"))
    if runs is not None:
        last = join_on(runs.select("run_id").distinct(), last, ["run_id"], "left")
    return last.select("run_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("last_iter", "last_batch")])


# Building entries ----------------------------------------------------------------------------


def number_candidates(candidates: DataFrame, log: DataFrame, order: str) -> DataFrame:
    """Give new candidates the iterations after the run's last one, all in the next batch.

    ``order`` is a position that sorts, unique in a run; it may be sparse.
    """
    numbered = running(candidates, ["run_id"], order, sums={"_number": F.lit(1)})
    last = log_position(log)
    joined = join_on(numbered, last, ["run_id"], "left")
    return joined.select(
        *candidates.columns,
        (F.coalesce("last_iter", F.lit(0)) + F.col("_number")).alias("iter"),
        (F.coalesce("last_batch", F.lit(0)) + 1).alias("batch"),
    )


def build_entries(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Log rows from scored (run, artifact, split) rows; artifacts without all three splits are left out.

    Rows are keyed by content hash, so siblings that share a plan id keep their own metrics.
    """
    metrics = list(fixed.METRIC_SYMBOLS)
    of = lambda metric, split: F.max(F.when(F.col("split") == split, F.col(metric))).alias(f"{metric}_{split}")
    wide = results.groupBy("run_id", "artifact_hash").agg(
        F.count_distinct("split").alias("_splits"), *[of(m, s) for s in fixed.SPLITS for m in metrics]
    )
    complete = wide.where(F.col("_splits") == len(fixed.SPLITS)).drop("_splits")
    return join_on(artifacts, complete, ["run_id", "artifact_hash"])


# Lineage -------------------------------------------------------------------------------------


def parent_delta(log: DataFrame) -> DataFrame:
    """Metric differences between an entry and its parent; null where no parent is found."""
    metrics = list(fixed.METRIC_SYMBOLS)
    own = log.select(*ENTRY, "batch", "parent", "plan_id", *[or_zero(f"{m}_dev").alias(m) for m in metrics])
    base = log.select("run_id", F.col("iter").alias("parent"), *[or_zero(f"{m}_dev").alias(f"parent_{m}") for m in metrics])
    return own.join(base, ["run_id", "parent"], "left").select(
        *ENTRY, "batch", "parent", "plan_id", *metrics, "parent_kappa",
        *[(F.col(m) - F.col(f"parent_{m}")).alias(f"delta_{m}") for m in metrics],
    )


def merge_parents(selections: DataFrame, log: DataFrame) -> DataFrame:
    """The entries named by a merge, with the base iteration (the highest one named).

    Iterations that are not in the log drop out of the parents.
    """
    named = selections.where(F.size("iters") > 0).select(
        "run_id", "selection_id", F.array_max("iters").alias("base_iter"), F.explode(F.array_distinct("iters")).alias("iter")
    )
    return named.join(log.select(*ENTRY, "artifact_hash", "artifact"), list(ENTRY))


def _known_parents(log: DataFrame) -> DataFrame:
    """``run_id, iter, parent`` with parents that are not in the log as null."""
    present = log.select("run_id", F.col("iter").alias("parent"), F.lit(True).alias("_present"))
    return log.select(*ENTRY, "parent").join(present, ["run_id", "parent"], "left").select(
        *ENTRY, F.when(F.col("_present"), F.col("parent")).alias("parent")
    )


def _rounds(nodes: DataFrame) -> int:
    """Rounds of doubling that reach the root of any entry, however its run is chained."""
    longest = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, longest - 1).bit_length() + 1


def lineage(log: DataFrame) -> DataFrame:
    """Depth and root of every entry, by pointer doubling; ``cyclic`` marks entries that have no root.

    Every round joins the unfinished entries with the pointers of the entries they point to, so a
    chain of n entries takes log2(n) rounds; an entry that points to its root is finished and does
    not join again. Each round is a written table. Entries still unfinished after as many rounds as
    the longest run can need lie on a cycle of parents or lead to one: their root and depth are null.
    """
    nodes = settle(_known_parents(log), "lineage-nodes")
    is_root = nodes.select("run_id", F.col("iter").alias("to"), F.col("parent").isNull().alias("done"))
    state = settle(
        nodes.where(F.col("parent").isNotNull())
        .select(*ENTRY, F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("depth"))
        .join(is_root, ["run_id", "to"])
        .select(*ENTRY, "to", "done", "depth"),
        "lineage-state",
    )
    for _ in range(_rounds(nodes)):
        unfinished = state.where(~F.col("done"))
        if unfinished.isEmpty():
            break
        ahead = state.select(
            "run_id", F.col("iter").alias("to"), F.col("to").alias("_to"),
            F.col("done").alias("_done"), F.col("depth").alias("_depth"),
        )
        moved = unfinished.drop("done").join(ahead, ["run_id", "to"]).select(
            *ENTRY, F.col("_to").alias("to"), F.col("_done").alias("done"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        state = settle(state.where("done").unionByName(moved), "lineage-state")
    roots = nodes.where(F.col("parent").isNull()).select(
        *ENTRY, F.col("iter").alias("root_iter"), F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("cyclic")
    )
    reached = [F.when(F.col("done"), F.col(c)).alias(n) for c, n in (("to", "root_iter"), ("depth", "depth"))]
    return roots.unionByName(state.select(*ENTRY, *reached, (~F.col("done")).alias("cyclic")))


def ancestors(log: DataFrame, targets: DataFrame) -> DataFrame:
    """All entries on the way from each target (``run_id, iter``) to its root, with their distance.

    After k rounds the chains reach 2**k - 1 entries back; each round extends them by the pointers
    to the 2**k-th ancestor and doubles those pointers. On a cycle of parents every entry stands
    once, at its least distance.
    """
    nodes = settle(_known_parents(log), "ancestor-nodes")
    jump = settle(
        nodes.where(F.col("parent").isNotNull()).select(*ENTRY, F.col("parent").alias("to")),
        "ancestor-jump",
    )
    chain = settle(
        targets.select("run_id", F.col("iter").alias("target_iter"), "iter", F.lit(0).cast("bigint").alias("distance")),
        "ancestor-chain",
    )
    length, rounds = 1, _rounds(nodes)
    while not jump.isEmpty():
        if not rounds:
            return chain.groupBy("run_id", "target_iter", "iter").agg(F.min("distance").alias("distance"))
        rounds -= 1
        further = chain.join(jump, list(ENTRY)).select(
            "run_id", "target_iter", F.col("to").alias("iter"), (F.col("distance") + length).alias("distance")
        )
        chain = settle(chain.unionByName(further), "ancestor-chain")
        next_jump = jump.select("run_id", F.col("iter").alias("to"), F.col("to").alias("_to"))
        jump = settle(
            jump.join(next_jump, ["run_id", "to"]).select(*ENTRY, F.col("_to").alias("to")), "ancestor-jump"
        )
        length *= 2
    return chain


# Plan statistics -----------------------------------------------------------------------------


def batch_winners(log: DataFrame) -> DataFrame:
    """Entry and plan with the best dev kappa of each batch."""
    won = F.max(
        F.struct(or_zero("kappa_dev").alias("kappa"), (-F.col("iter")).alias("back"), F.col("plan_id").alias("plan"))
    )
    return log.groupBy("run_id", "batch").agg(won.alias("w")).select(
        "run_id", "batch", (-F.col("w.back")).alias("iter"), F.col("w.plan").alias("plan_id"),
        F.col("w.kappa").alias("kappa_dev"),
    )


def batch_best(log: DataFrame) -> DataFrame:
    """Best dev kappa of each batch."""
    return log.groupBy("run_id", "batch").agg(F.max(or_zero("kappa_dev")).alias("best_kappa_dev"))


def plan_statistics(log: DataFrame) -> DataFrame:
    """Per run and plan: proposals, wins and mean dev-kappa gain over the parent.

    ``won`` counts every proposal in a batch whose winner has the same plan, so two siblings of
    one plan both count; ``won_entries`` counts the winning entries themselves. The mean is 0.0
    for a plan without any known parent.
    """
    winners = batch_winners(log).select(
        "run_id", "batch", F.col("iter").alias("_win_iter"), F.col("plan_id").alias("_win_plan")
    )
    deltas = parent_delta(log).select(*ENTRY, "batch", "plan_id", "delta_kappa")
    flagged = deltas.join(winners, ["run_id", "batch"])
    return flagged.groupBy("run_id", "plan_id").agg(
        F.count(F.lit(1)).alias("proposed"),
        F.sum(F.when(F.col("_win_plan") == F.col("plan_id"), 1).otherwise(0)).alias("won"),
        F.sum(F.when(F.col("_win_iter") == F.col("iter"), 1).otherwise(0)).alias("won_entries"),
        F.coalesce(F.avg("delta_kappa"), F.lit(0.0)).alias("mean_delta_dev"),
    )


def plan_table(log: DataFrame) -> DataFrame:
    """Plan statistics with the win rate in percent, best mean gain first."""
    stats = plan_statistics(log)
    return stats.withColumn("win_rate", ratio(F.col("won") * 100, F.col("proposed"))).orderBy(
        "run_id", F.desc("mean_delta_dev"), "plan_id"
    )


def win_rate(log: DataFrame, alarm: float = fixed.WIN_RATE_ALARM) -> DataFrame:
    """Share of proposals that beat their parent, so far, in iteration order.

    This "win" is a gain over the parent and differs from winning a batch.
    """
    judged = parent_delta(log).where(F.col("delta_kappa").isNotNull())
    sums = {"wins": F.when(F.col("delta_kappa") > 0, 1).otherwise(0), "judged": F.lit(1)}
    so_far = running(judged.select(*ENTRY, "delta_kappa"), ["run_id"], "iter", sums=sums)
    rate = ratio(F.col("wins"), F.col("judged"))
    return so_far.select(*ENTRY, "delta_kappa", "wins", "judged", rate.alias("win_rate"), (rate < alarm).alias("alarm"))


def run_win_rate(log: DataFrame) -> DataFrame:
    """Win rate (gain over the parent) of a whole run."""
    wins = F.sum(F.when(F.col("delta_kappa") > 0, 1).otherwise(0))
    judged = parent_delta(log).where(F.col("delta_kappa").isNotNull())
    return judged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("judged"), wins.alias("wins"), ratio(wins, F.count(F.lit(1))).alias("win_rate")
    )


# Reports -------------------------------------------------------------------------------------


def last_entries(log: DataFrame, count: int) -> DataFrame:
    """The last ``count`` entries of each run; Spark limits each run before the shuffle."""
    order = Window.partitionBy("run_id").orderBy(F.desc("iter"))
    return log.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= count).drop("_back")


def history_view(
    log: DataFrame, full_count: int = fixed.HISTORY_FULL_COUNT, parents: DataFrame | None = None
) -> DataFrame:
    """Mark the entries to show in full: the best one, the last ones, and the selected ``parents``."""
    full = (
        last_entries(log.select(*ENTRY), full_count).withColumn("_why", F.lit("last"))
        .unionByName(log.groupBy("run_id").agg(_best_iter()).withColumn("_why", F.lit("best")))
    )
    if parents is not None:
        full = full.unionByName(parents.select(*ENTRY).withColumn("_why", F.lit("parent")))
    why = full.groupBy(*ENTRY).agg(*[F.max(F.col("_why") == w).alias(f"is_{w}") for w in ("best", "last", "parent")])
    flags = [F.coalesce(f"is_{w}", F.lit(False)).alias(f"is_{w}") for w in ("best", "last", "parent")]
    shown = join_on(log, why, ENTRY, "left").select(*log.columns, *flags)
    return shown.withColumn("full", F.col("is_best") | F.col("is_last") | F.col("is_parent"))


def history_lines(view: DataFrame) -> DataFrame:
    """The text of each entry of a history view, in full or as one line; test metrics stay out."""
    parent = F.coalesce(F.col("parent").cast("string"), F.lit(fixed.NO_PARENT))
    head = (F.col("iter"), F.col("batch"), parent, F.col("plan_id"))
    kappas = (fixed3(or_zero("kappa_train")), fixed3(or_zero("kappa_dev")))
    noted = F.coalesce("stage_a_summary", F.lit("")) != ""
    summary = F.when(noted, F.format_string(fixed.HISTORY_SUMMARY, "stage_a_summary")).otherwise("")
    long_text = F.format_string(fixed.HISTORY_FULL, *head, F.col("rationale"), *kappas, F.col("artifact"), summary)
    reason = F.substring("rationale", 1, fixed.COMPACT_RATIONALE_CHARS)
    short_text = F.format_string(fixed.HISTORY_COMPACT, *head, *kappas, reason)
    return view.select(*ENTRY, "full", F.when(F.col("full"), long_text).otherwise(short_text).alias("line"))


def best_callout(log: DataFrame) -> DataFrame:
    """The best entry of a run with its dev-test gap."""
    return best_entry(log).select(
        *ENTRY, "batch", "plan_id", *[or_zero(f"kappa_{s}").alias(f"kappa_{s}") for s in ("dev", "train", "test")],
        _gap().alias("gap"), "rationale", "artifact",
    )


def batch_details(log: DataFrame) -> DataFrame:
    """One report row per entry, with its dev-test gap and a short rationale."""
    return log.select(
        "run_id", "batch", "iter", "parent", "plan_id",
        shorten(F.col("rationale"), fixed.REPORT_RATIONALE_CHARS).alias("rationale"),
        *[or_zero(f"kappa_{s}").alias(f"kappa_{s}") for s in fixed.SPLITS], _gap().alias("gap"),
    ).orderBy("run_id", "batch", "iter")


def gap_trend(log: DataFrame, count: int = fixed.GAP_TREND_LENGTH) -> DataFrame:
    """Dev-test gap of the last entries of each run."""
    narrow = log.select(*ENTRY, or_zero("kappa_dev").alias("kappa_dev"), or_zero("kappa_test").alias("kappa_test"))
    return last_entries(narrow, count).withColumn("gap", _gap()).orderBy(*ENTRY)


def run_summary(log: DataFrame) -> DataFrame:
    """Iterations, batches, best and latest entry of each run, in one aggregation."""
    kappas = [or_zero("kappa_dev").alias("dev"), (-F.col("iter")).alias("back"), or_zero("kappa_test").alias("test")]
    latest = F.struct("iter", or_zero("kappa_dev").alias("dev"), or_zero("kappa_test").alias("test"))
    out = log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.max("batch").alias("batches"),
        F.max(F.struct(*kappas)).alias("b"),
        F.max(latest).alias("l"),
    )
    return out.select(
        "run_id", "iterations", "batches",
        (-F.col("b.back")).alias("best_iter"), F.col("b.dev").alias("best_kappa_dev"),
        F.col("b.test").alias("best_kappa_test"), (F.col("b.dev") - F.col("b.test")).alias("best_gap"),
        F.col("l.iter").alias("latest_iter"), F.col("l.dev").alias("latest_kappa_dev"),
        F.col("l.test").alias("latest_kappa_test"), (F.col("l.dev") - F.col("l.test")).alias("latest_gap"),
    )


def gap_bands(log: DataFrame) -> DataFrame:
    """Healthy below 0.05, warning above 0.10, caution between."""
    gap = F.round(_gap(), 9)
    band = F.when(gap < fixed.GAP_HEALTHY, "healthy").when(gap <= fixed.GAP_WARNING, "caution").otherwise("warning")
    return log.select(*ENTRY, _gap().alias("gap"), band.alias("band"))


def gap_growth(log: DataFrame, alarm_after: int = 3) -> DataFrame:
    """For how many iterations in a row the dev-test gap has grown, and whether that is an alarm."""
    gaps = log.select(*ENTRY, _gap().alias("gap"))
    rises = (F.col("gap"), lambda before, now: now > before)
    steps = running(gaps, ["run_id"], "iter", previous={"previous_gap": F.col("gap")}, streaks={"streak": rises})
    return steps.select(
        *ENTRY, "gap", "previous_gap", (F.col("streak") > 0).alias("growing"), "streak", (F.col("streak") >= alarm_after).alias("alarm")
    )


def running_best(log: DataFrame) -> DataFrame:
    """Best dev kappa so far, and the gain of an entry over the best before it."""
    narrow = log.select(*ENTRY, or_zero("kappa_dev").alias("kappa_dev"))
    kappa = {"best_so_far": F.col("kappa_dev")}
    best = running(narrow, ["run_id"], "iter", maxima=kappa, maxima_before={"best_before": F.col("kappa_dev")})
    return best.withColumn("gain", F.greatest(F.col("kappa_dev") - F.col("best_before"), F.lit(0.0)))


def run_comparison(log: DataFrame) -> DataFrame:
    """Runs side by side, placed by their best dev kappa."""
    summary = run_summary(log).select(
        "run_id", "iterations", "batches", "best_iter", "best_kappa_dev", "best_kappa_test", "best_gap"
    )
    return place(summary, [F.desc("best_kappa_dev"), F.asc("run_id")], "place")
