"""The registered queries: every operator on the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.numbers import rounded
from evalspark.operators import artifacts as A
from evalspark.operators import dag as G
from evalspark.operators import diagnosis as D
from evalspark.operators import extract as X
from evalspark.operators import ledger as H
from evalspark.operators import log as L
from evalspark.operators import metrics as M
from evalspark.operators import scoring as C
from evalspark.operators import splits as S
from evalspark.plans import bindings as B
from evalspark.plans.session import ship_package
from evalspark.plans.shared import new_folder, settle
from evalspark.sources import cache as K
from evalspark.sources import cells as N
from evalspark.sources import jsonl as J
from evalspark.sources import snapshots as SN
from evalspark.streaming import log_stream as R
from evalspark.streaming import score_stream as RS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return B.stored(spark, sf, B.log)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return B.stored(spark, sf, B.predictions)


KAPPAS = ("kappa_train", "kappa_dev", "kappa_test")
METRICS = ("kappa", "f1", "spearman")


# Sources and sinks ---------------------------------------------------------------------------


def _example_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Examples as JSON lines; toxic ones carry ``ground_truth`` in place of ``label``."""
    docs = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id")
    label = F.col("quality").cast("string")
    toxic = F.col("toxic") == 1
    return docs.select(
        F.to_json(
            F.struct(
                F.col("doc_id").alias("id"), F.col("text").alias("input"), F.when(~toxic, label).alias("label"),
                F.when(toxic, label).alias("ground_truth"), F.col("source").alias("domain"), F.col("lang").alias("other"),
            )
        ).alias("value")
    )


@query
def read_examples(spark, sf):
    path = new_folder(spark, "examples")
    # A blank line after every object, as a scan must skip those.
    _example_lines(spark, sf).select(F.concat("value", F.lit("\n"))).write.text(path)
    return J.read_examples(spark, path).select("id", "input", "label", "domain")


@query
def bad_example_lines(spark, sf):
    """Lines of a damaged file that are no example: every tenth is cut off, every tenth has a text as id."""
    path = new_folder(spark, "damaged-examples")
    lines = _example_lines(spark, sf).withColumn("_id", F.get_json_object("value", "$.id").cast("bigint"))
    cut = F.expr("substring(value, 1, length(value) - 1)")
    odd = F.regexp_replace("value", r'^\{"id":(\d+)', r'{"id":"q-$1"')
    damaged = F.when(F.col("_id") % 10 == 3, cut).when(F.col("_id") % 10 == 7, odd).otherwise(F.col("value"))
    lines.select(damaged).write.text(path)
    bad = J.bad_example_lines(spark, path)
    number = F.regexp_extract("line", r'"id":"?(?:q-)?(\d+)', 1).cast("bigint")
    return bad.select(number.alias("id"), F.col("line").endswith("}").alias("whole"))


@query
def write_splits(spark, sf):
    path = new_folder(spark, "splits")
    J.write_splits(B.examples(spark, sf).drop("run_id"), path)
    return J.read_splits(spark, path).select("id", "input", "label", "domain", "split")


def _log_folder(spark, sf) -> str:
    path = new_folder(spark, "log")
    J.append_log(J.log_rows(_log(spark, sf)), path)
    return path


@query
def append_log(spark, sf):
    path = new_folder(spark, "log")
    rows = J.log_rows(_log(spark, sf))
    J.append_log(rows.where(F.col("batch") <= 4), path)
    # The resumed writer offers everything again; only what is missing is added.
    J.append_log(rows, path, existing=J.read_log(spark, path))
    return J.read_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("iter").alias("iterations"), F.max("batch").alias("batches")
    )


@query
def read_log(spark, sf):
    entries = J.flat_log(J.read_log(spark, _log_folder(spark, sf)))
    return rounded(entries, 9, *KAPPAS).select(
        "run_id", "iter", "batch", "ts", "artifact_hash", "parent", "plan_id", "rationale", "artifact", *KAPPAS
    )


@query
def log_integrity(spark, sf):
    path = new_folder(spark, "log-lines")
    lines = J.log_rows(_log(spark, sf)).select("iter", F.to_json(F.struct("*")).alias("value"))
    cut = F.expr("substring(value, 1, length(value) div 2)")
    lines.select(F.when(F.col("iter") % 10 == 0, cut).otherwise(F.col("value"))).write.text(path)
    return J.log_integrity(spark, path).agg(F.sum("valid").alias("valid"), F.sum("corrupt").alias("corrupt"))


@query
def duplicate_entries(spark, sf):
    log = _log(spark, sf).select("run_id", "iter", "batch")
    return J.duplicate_entries(log.unionByName(log.where(F.col("batch") == 2)))


@query
def log_rewrites(spark, sf):
    old = _log(spark, sf)
    new = old.withColumn("rationale", F.when(F.col("iter") % 10 == 0, F.lit("changed")).otherwise(F.col("rationale")))
    return J.log_rewrites(old, new)


def _snapshots(spark, sf) -> tuple[str, str, DataFrame]:
    """Two stored snapshots of the log: in the newer one every tenth rationale has changed and a batch was added."""
    old = _log(spark, sf)
    new = old.withColumn("rationale", F.when(F.col("iter") % 10 == 0, F.lit("changed")).otherwise(F.col("rationale")))
    paths = new_folder(spark, "snapshot"), new_folder(spark, "snapshot")
    SN.write_snapshot(old, paths[0], 4)
    SN.write_snapshot(new.unionByName(old.where("batch = 1").withColumn("iter", F.col("iter") + 1000)), paths[1], 4)
    return *paths, old


@query
def snapshot_rewrites(spark, sf):
    return SN.snapshot_rewrites(spark, *_snapshots(spark, sf))


@query
def changed_log_blocks(spark, sf):
    old, new, _ = _snapshots(spark, sf)
    return SN.changed_blocks(SN.read_digests(spark, old), SN.read_digests(spark, new))


@query
def parse_scorer_output(spark, sf):
    rows = B.table(spark, sf, "conversations")
    text, shape = F.col("text"), F.col("turn") % 6
    named = lambda k: F.to_json(F.struct(F.col("conv_id").alias("id"), text.alias(k)))
    line = (
        F.when(shape == 0, named("prediction")).when(shape == 1, named("label")).when(shape == 2, F.lit("{}"))
        .when(shape == 3, F.replace(text, F.lit("\n"), F.lit(" "))).when(shape == 4, F.col("conv_id").cast("string"))
        .otherwise(F.lit('{"prediction": "cut'))
    )
    return J.parse_scorer_output(rows.select("conv_id", "turn", line.alias("line")))


# Sampling and splitting ----------------------------------------------------------------------


@query
def subsample(spark, sf):
    return S.subsample(B.examples(spark, sf), 100).select("run_id", "id", "label")


@query
def subsample_lines(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(*B.LINE_KEY)
    return S.subsample(lines, 20_000, B.LINE_KEY)


@query
def stratified_split(spark, sf):
    rows = B.examples(spark, sf).select("run_id", "id", "domain")
    return S.stratified_split(rows, by=["run_id"])


@query
def stratified_split_scalable(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(*B.LINE_KEY, "l_returnflag")
    return S.stratified_split(lines, "l_returnflag", identity=B.LINE_KEY)


def _grown(spark, sf) -> DataFrame:
    """Seven tenths of the examples are split and published, then the rest joins them."""
    rows = B.examples(spark, sf).select("run_id", "id", "domain")
    first = F.col("id") % 10 < 7
    published = settle(S.stratified_split(rows.where(first), by=["run_id"]), "published-split")
    return published.unionByName(S.grow_split(published, rows.where(~first), by=["run_id"]))


@query
def grown_split(spark, sf):
    return _grown(spark, sf)


@query
def split_drift(spark, sf):
    return S.split_drift(_grown(spark, sf), by=["run_id"])


@query
def hash_split(spark, sf):
    return B.examples(spark, sf).select("run_id", "id", "split")


@query
def split_statistics(spark, sf):
    return rounded(S.split_statistics(B.examples(spark, sf), by=["run_id"]), 9, "share")


@query
def split_balance(spark, sf):
    return rounded(S.split_balance(B.examples(spark, sf), by=["run_id"]), 9, "largest_gap")


@query
def dataset_gates(spark, sf):
    return S.dataset_gates(B.examples(spark, sf), B.artifacts(spark, sf))


@query
def rare_strata(spark, sf):
    return S.rare_strata(B.examples(spark, sf), by=["run_id"], minimum=3)


# Artifacts -----------------------------------------------------------------------------------


@query
def artifact_hash(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("artifact"))
    return A.with_artifact_hash(rows).select("doc_id", "artifact_hash")


@query
def dedupe_artifacts(spark, sf):
    rows = B.table(spark, sf, "documents").select(
        F.col("lang").alias("run_id"), F.col("doc_id").alias("iter"), F.col("text").alias("artifact")
    )
    return A.dedupe_artifacts(A.with_artifact_hash(rows)).select("run_id", "iter", "artifact_hash")


@query
def selector_view(spark, sf):
    view = A.selector_view(_log(spark, sf)).drop("stage_a_summary")
    return rounded(view, 9, *[f"{m}_{s}" for m in METRICS for s in ("train", "dev")])


# Pairing and scoring -------------------------------------------------------------------------


@query
def score_pairs(spark, sf):
    arts = B.distinct_artifacts(spark, sf).select("run_id", "artifact_hash")
    return C.score_pairs(arts, B.examples(spark, sf).select("run_id", "split", "id"))


def _cached(spark, sf) -> DataFrame:
    """A cache that knows train and test predictions of the artifacts of the first three batches."""
    known = B.artifacts(spark, sf).where(F.col("batch") <= 3).select("run_id", "artifact_hash").distinct()
    rows = _predictions(spark, sf).join(known, ["run_id", "artifact_hash"], "left_semi")
    return rows.where(F.col("split") != "dev").select(*C.PAIR_KEY, "prediction")


@query
def align_predictions(spark, sf):
    have = _predictions(spark, sf).where(~((F.col("split") == "dev") & (F.col("label") == "1")))
    surplus = have.withColumn("id", -F.col("id") - 1)
    return C.align_predictions(
        B.examples(spark, sf), have.unionByName(surplus), B.distinct_artifacts(spark, sf)
    )


def _appended_cache(spark, sf) -> str:
    """A cache written by three appends, of which the last repeats a part of the first."""
    path, rows = new_folder(spark, "cache"), _cached(spark, sf).withColumn("error", F.lit(None).cast("string"))
    for part in (F.col("split") == "train", F.col("split") != "train", (F.col("split") == "train") & (F.col("id") % 3 == 0)):
        K.append_cache(rows.where(part), path)
    return path


@query
def cache_ledger(spark, sf):
    ledger = H.united(K.read_ledger(spark, _appended_cache(spark, sf)))
    return ledger.select(*H.LEDGER_KEY, F.bitmap_count("bits").alias("cached"))


@query
def pending_pairs(spark, sf):
    ledger = K.read_ledger(spark, _appended_cache(spark, sf))
    return C.pending_pairs(B.distinct_artifacts(spark, sf), B.examples(spark, sf), ledger=ledger)


@query
def cache_hit_rate(spark, sf):
    ledger = K.read_ledger(spark, _appended_cache(spark, sf))
    return rounded(C.cache_hit_rate(B.distinct_artifacts(spark, sf), B.examples(spark, sf), ledger=ledger), 9, "hit_rate")


def _all_work(spark, sf) -> DataFrame:
    return C.scoring_work(B.distinct_artifacts(spark, sf), B.examples(spark, sf))


@query
def score(spark, sf):
    return C.score(_all_work(spark, sf), B.hash_scorer_function)


@query
def score_retry(spark, sf):
    return C.score_with_retries(_all_work(spark, sf), B.flaky_scorer_function)


@query
def score_retry_last(spark, sf):
    attempts = C.score_with_retries(_all_work(spark, sf), B.flaky_scorer_function)
    return C.last_attempts(attempts)


def _failing_scorer(artifact, chunk, temperature):
    """The hash scorer, refusing artifacts that start with a vowel."""
    if artifact[:1].lower() in "aeiou":
        raise ValueError("vowel")
    return B.hash_scorer_function(artifact, chunk, temperature)


@query
def score_artifacts(spark, sf):
    path = new_folder(spark, "cache")
    K.append_cache(_cached(spark, sf).withColumn("error", F.lit(None).cast("string")), path)
    out = K.score_artifacts(
        B.distinct_artifacts(spark, sf), B.examples(spark, sf), _failing_scorer, K.read_cache(spark, path), path, ledger=K.read_ledger(spark, path)
    )
    return rounded(out, 9, *METRICS)


@query
def score_batch(spark, sf):
    arts = B.artifacts(spark, sf)
    results = K.score_artifacts(arts, B.examples(spark, sf), B.hash_scorer_function, K.empty_cache(spark))
    entries = L.build_entries(results.where("success"), arts)
    names = [f"{m}_{s}" for m in METRICS for s in ("train", "dev", "test")]
    return rounded(entries, 9, *names).select("run_id", "iter", "artifact_hash", "plan_id", *names)


@query
def finished_run_is_cached(spark, sf):
    arts, exs = B.distinct_artifacts(spark, sf), B.examples(spark, sf)
    path = new_folder(spark, "cache")
    K.score_artifacts(arts, exs, B.hash_scorer_function, K.empty_cache(spark), path)
    return C.pending_pairs(arts, exs, ledger=K.read_ledger(spark, path)).agg(F.count(F.lit(1)).alias("pending"))


@query
def hash_scorer(spark, sf):
    names = B.distinct_artifacts(spark, sf).select("run_id", "artifact_hash")
    pairs = C.score_pairs(names, B.examples(spark, sf).drop("input"))
    return C.hash_scorer(pairs).select(*C.PAIR_KEY, "label", "prediction")


@query
def response_health(spark, sf):
    return C.response_health(B.responses(spark, sf))


@query
def response_rates(spark, sf):
    out = C.response_rates(C.response_health(B.responses(spark, sf)), ["role"])
    return rounded(out, 9, "has_think_rate", "think_closed_rate", "has_prompt_rate", "truncated_rate")


# Metrics -------------------------------------------------------------------------------------


@query
def contingency(spark, sf):
    return M.contingency(B.big_predictions(spark, sf))


@query
def confusion_matrix(spark, sf):
    return M.confusion_matrix(B.big_predictions(spark, sf), ["A", "N", "R"])


@query
def cohen_kappa(spark, sf):
    return rounded(M.cohen_kappa(_predictions(spark, sf)), 9, "kappa")


@query
def macro_f1(spark, sf):
    return rounded(M.macro_f1(_predictions(spark, sf)), 9, "f1")


@query
def spearman(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("group"), F.col("l_quantity").cast("int").cast("string").alias("label"),
        F.when(F.col("l_linenumber") > 3, F.round(F.col("l_discount") * 100).cast("int").cast("string"))
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("prediction"),
    )
    return rounded(M.spearman(rows, ["group"]), 9, "spearman")


@query
def spearman_ordinal(spark, sf):
    known = {k: v for k, v in B.LABEL_ORDER.items() if k != "N"}
    return rounded(M.spearman(B.big_predictions(spark, sf), label_order=known), 9, "spearman")


@query
def spearman_continuous(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    return rounded(M.spearman_continuous(lines, ["l_linestatus"], "l_quantity", "l_extendedprice"), 9, "spearman")


@query
def all_metrics(spark, sf):
    return rounded(M.all_metrics(B.big_predictions(spark, sf), label_order=B.LABEL_ORDER), 9, *METRICS)


@query
def maintained_metrics(spark, sf):
    """Metrics from cells that three appends kept up to date: a first guess, then what replaces it, in two parts."""
    path, rows = new_folder(spark, "cells"), _predictions(spark, sf)
    N.new_store(spark, path)
    late = F.col("id") % 3 == 0
    guess = F.when(late, F.lit("guess")).otherwise(F.col("prediction"))
    N.append_predictions(rows.withColumn("prediction", guess), path, 1)
    N.append_predictions(rows.where(late & (F.col("split") != "test")), path, 2)
    N.compact(spark, path)
    N.append_predictions(rows.where(late & (F.col("split") == "test")), path, 3)
    return rounded(M.metrics_of_cells(N.current_cells(spark, path)), 9, *METRICS)


@query
def all_metrics_of_empty_groups(spark, sf):
    have = _predictions(spark, sf).where((F.col("split") == "train") | (F.col("run_id") == "en"))
    groups = C.score_pairs(
        B.distinct_artifacts(spark, sf).select("run_id", "artifact_hash"),
        B.examples(spark, sf).groupBy("run_id", "split").agg(F.first("id").alias("id")),
    )
    return rounded(M.all_metrics(have, groups=groups), 9, *METRICS)


@query
def metric_delta(spark, sf):
    rows = J.log_rows(_log(spark, sf))
    old = rows.select("run_id", F.col("iter").alias("parent"), F.map_filter("metrics_dev", lambda k, _: k != "f1").alias("old"))
    new = rows.select("run_id", "iter", "parent", F.col("metrics_dev").alias("new"))
    deltas = new.join(old, ["run_id", "parent"]).select(
        "run_id", "iter", F.explode(M.metric_delta("old", "new")).alias("metric", "delta")
    )
    return rounded(deltas, 9, "delta")


@query
def metrics_string(spark, sf):
    return J.log_rows(_log(spark, sf)).select("run_id", "iter", M.metrics_string("metrics_dev").alias("metrics"))


@query
def per_class_report(spark, sf):
    return rounded(M.per_class_report(_predictions(spark, sf)), 9, "precision", "recall", "f1")


@query
def combined_kappa(spark, sf):
    combined = {"dev+test": ["dev", "test"], "all": ["train", "dev", "test"]}
    return rounded(M.combined_kappa(_predictions(spark, sf), combined), 9, "kappa")


@query
def metric_disagreement(spark, sf):
    deltas = L.parent_delta(_log(spark, sf)).where(F.col("parent_kappa").isNotNull())
    return M.metric_disagreement(deltas).select("run_id", "iter", "disagree")


# Diagnosis -----------------------------------------------------------------------------------


@query
def error_samples(spark, sf):
    return D.error_samples(_predictions(spark, sf), B.examples(spark, sf))


@query
def balanced_errors(spark, sf):
    return D.balanced_errors(_predictions(spark, sf), B.examples(spark, sf))


@query
def error_types(spark, sf):
    return rounded(D.error_types(_predictions(spark, sf)), 9, "share")


@query
def error_digest(spark, sf):
    return D.error_digest(D.error_samples(_predictions(spark, sf), B.examples(spark, sf)))


# Log analytics -------------------------------------------------------------------------------


@query
def entry_by_iter(spark, sf):
    return rounded(L.entry_by_iter(_log(spark, sf), 7), 9, *KAPPAS).select("run_id", "iter", "plan_id", "artifact", *KAPPAS)


@query
def best_entry(spark, sf):
    return rounded(L.best_entry(_log(spark, sf)), 9, *KAPPAS).select("run_id", "iter", "plan_id", "artifact", *KAPPAS)


@query
def entries_by_batch(spark, sf):
    return rounded(L.entries_by_batch(_log(spark, sf), 3), 9, *KAPPAS).select("run_id", "iter", "batch", "plan_id", *KAPPAS)


@query
def log_position(spark, sf):
    runs = B.table(spark, sf, "documents").select(F.col("lang").alias("run_id")).unionByName(
        B.table(spark, sf, "documents").select(F.col("source").alias("run_id"))
    )
    return L.log_position(_log(spark, sf), runs)


@query
def number_candidates(spark, sf):
    numbered = L.number_candidates(B.candidate_rows(spark, sf), _log(spark, sf), "candidate_id")
    return numbered.select("run_id", "candidate_id", "plan_id", "iter", "batch")


@query
def build_entries(spark, sf):
    results = M.all_metrics(_predictions(spark, sf).where(~((F.col("split") == "test") & (F.col("run_id") == "es"))))
    names = [f"{m}_{s}" for m in METRICS for s in ("train", "dev", "test")]
    entries = L.build_entries(results, B.artifacts(spark, sf))
    return rounded(entries, 9, *names).select("run_id", "iter", "artifact_hash", "plan_id", *names)


@query
def parent_delta(spark, sf):
    names = [*METRICS, "parent_kappa", *[f"delta_{m}" for m in METRICS]]
    return rounded(L.parent_delta(_log(spark, sf)), 9, *names)


@query
def merge_parents(spark, sf):
    log = _log(spark, sf)
    chosen = X.parse_selection(B.selections(spark, sf), L.best_entry(log)).where(F.col("action").startswith("merge="))
    return L.merge_parents(chosen, log).select("run_id", "selection_id", "base_iter", "iter", "artifact_hash")


@query
def lineage(spark, sf):
    return L.lineage(_log(spark, sf)).drop("cyclic")


@query
def lineage_with_cycles(spark, sf):
    """A log in which entries 2 and 3 name each other and entry 6 names itself."""
    at = F.col("iter")
    parent = F.when(at == 2, 3).when(at == 3, 2).when(at == 6, 6).otherwise(F.col("parent")).cast("bigint")
    return L.lineage(_log(spark, sf).withColumn("parent", parent))


def _merge_edges(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The log, and its edges where every batch from the second on was made from a merge that a selection asked for."""
    log = _log(spark, sf)
    chosen = X.parse_selection(B.selections(spark, sf), L.best_entry(log)).where(F.col("action").startswith("merge="))
    batch = (F.col("selection_id") % 8 + 2).cast("bigint")
    merges = chosen.groupBy("run_id", batch.alias("batch")).agg(F.max_by("iters", "selection_id").alias("iters"))
    return log, settle(G.lineage_edges(log, merges), "lineage-edges")


@query
def lineage_dag(spark, sf):
    """Depths and number of roots where merges named earlier entries only."""
    log, edges = _merge_edges(spark, sf)
    return G.lineage_dag(log, edges.where("parent < iter"))


@query
def lineage_dag_with_cycles(spark, sf):
    """The same with merges that name entries of later batches, or an entry itself."""
    return G.lineage_dag(*_merge_edges(spark, sf))


@query
def lineage_roots(spark, sf):
    log, edges = _merge_edges(spark, sf)
    return G.lineage_roots(log, edges.where("parent < iter"))


@query
def best_lineage(spark, sf):
    log = _log(spark, sf)
    return L.ancestors(log, L.best_entry(log))


@query
def history_view(spark, sf):
    log = _log(spark, sf)
    chosen = X.parse_selection(B.selections(spark, sf), L.best_entry(log))
    latest = chosen.groupBy("run_id").agg(F.max("selection_id").alias("selection_id"))
    parents = L.merge_parents(chosen.join(latest, ["run_id", "selection_id"], "left_semi"), log)
    return L.history_view(log, parents=parents).select("run_id", "iter", "is_best", "is_last", "is_parent", "full")


@query
def history_lines(spark, sf):
    return L.history_lines(L.history_view(_log(spark, sf)))


@query
def batch_winners(spark, sf):
    return rounded(L.batch_winners(_log(spark, sf)), 9, "kappa_dev")


@query
def plan_statistics(spark, sf):
    return rounded(L.plan_statistics(_log(spark, sf)), 9, "mean_delta_dev")


@query
def plan_statistics_from_tables(spark, sf):
    """The whole chain in one query: pair, score, count, evaluate, build the log, aggregate."""
    log = settle(B.log_without_store(spark, sf).select("run_id", "iter", "batch", "parent", "plan_id", "kappa_dev", "f1_dev", "spearman_dev"), "log")
    return rounded(L.plan_statistics(log), 9, "mean_delta_dev")


@query
def plan_table(spark, sf):
    return rounded(L.plan_table(_log(spark, sf)), 9, "mean_delta_dev", "win_rate")


@query
def best_callout(spark, sf):
    return rounded(L.best_callout(_log(spark, sf)), 9, *KAPPAS, "gap")


@query
def batch_details(spark, sf):
    return rounded(L.batch_details(_log(spark, sf)), 9, *KAPPAS, "gap")


@query
def gap_trend(spark, sf):
    return rounded(L.gap_trend(_log(spark, sf)), 9, "kappa_dev", "kappa_test", "gap")


@query
def run_summary(spark, sf):
    names = [f"{w}_{c}" for w in ("best", "latest") for c in ("kappa_dev", "kappa_test", "gap")]
    return rounded(L.run_summary(_log(spark, sf)), 9, *names)


@query
def batch_best(spark, sf):
    return rounded(L.batch_best(_log(spark, sf)), 9, "best_kappa_dev")


@query
def gap_bands(spark, sf):
    return rounded(L.gap_bands(_log(spark, sf)), 9, "gap")


@query
def gap_growth(spark, sf):
    return rounded(L.gap_growth(_log(spark, sf)), 9, "gap", "previous_gap")


@query
def running_best(spark, sf):
    return rounded(L.running_best(_log(spark, sf)), 9, "kappa_dev", "best_so_far", "best_before", "gain")


@query
def win_rate(spark, sf):
    return rounded(L.win_rate(_log(spark, sf)), 9, "delta_kappa", "win_rate")


@query
def run_win_rate(spark, sf):
    return rounded(L.run_win_rate(_log(spark, sf)), 9, "win_rate")


@query
def log_as_of(spark, sf):
    past = L.log_as_of(_log(spark, sf), 20)
    return rounded(L.plan_statistics(past), 9, "mean_delta_dev")


@query
def run_comparison(spark, sf):
    return rounded(L.run_comparison(_log(spark, sf)), 9, "best_kappa_dev", "best_kappa_test", "best_gap")


# Text extraction -----------------------------------------------------------------------------


@query
def extract_candidates(spark, sf):
    return X.extract_candidates(B.responses(spark, sf)).drop("role")


@query
def parse_selection(spark, sf):
    parsed = X.parse_selection(B.selections(spark, sf), L.best_entry(_log(spark, sf)))
    return parsed.withColumn("iters", F.array_join("iters", ","))


@query
def parse_merge(spark, sf):
    return X.parse_merge(B.merges(spark, sf))


@query
def user_constraints(spark, sf):
    return X.user_constraints(B.notes(spark, sf))


@query
def user_constraints_any_heading(spark, sf):
    return X.user_constraints(B.notes(spark, sf), strict=False)


@query
def notes_summary(spark, sf):
    return X.notes_summary(B.notes(spark, sf))


@query
def constraint_filter(spark, sf):
    kept = X.constraint_filter(B.candidate_rows(spark, sf), B.banned_terms(spark, sf))
    return kept.select("run_id", "candidate_id", "plan_id")


@query
def repeat_proposals(spark, sf):
    again = B.artifacts(spark, sf).select("run_id", "parent", "plan_id", "artifact", F.col("iter").alias("candidate_id"))
    new = again.withColumn("artifact", F.concat("artifact", F.lit("!"))).withColumn("candidate_id", F.col("candidate_id") + 1000)
    other = new.withColumn("plan_id", F.concat(F.lit("new_"), "plan_id")).withColumn("candidate_id", F.col("candidate_id") + 1000)
    log = _log(spark, sf)
    found = X.repeat_proposals(again.unionByName(new).unionByName(other), log)
    return found.select("run_id", "candidate_id", "artifact_hash", "same_text", "same_plan")


# Streaming -----------------------------------------------------------------------------------


@query
def stream_log(spark, sf):
    """Batch progress kept up to date by a stream over the log's files."""
    path, out, state = (new_folder(spark, n) for n in ("log-files", "progress", "progress-state"))
    J.log_rows(_log(spark, sf)).repartition(8).write.partitionBy("run_id").json(path)
    stream = R.batch_progress(R.log_stream(spark, path, files_per_batch=5))
    R.write_upserts(stream, out, state, ["run_id", "batch"], compact_every=3).awaitTermination()
    progress = R.read_upserts(spark, out, ["run_id", "batch"])
    return rounded(R.best_so_far(progress), 9, "best_kappa_dev", "best_so_far")


@query
def stream_plans(spark, sf):
    """Plan counts kept up to date by a stream over the log's files."""
    path, out, state = (new_folder(spark, n) for n in ("log-files", "plans", "plans-state"))
    J.log_rows(_log(spark, sf)).repartition(8).write.partitionBy("run_id").json(path)
    counts = R.plan_counts(R.log_stream(spark, path, files_per_batch=5))
    R.write_upserts(counts, out, state, ["run_id", "plan_id"], compact_every=2).awaitTermination()
    return R.read_upserts(spark, out, ["run_id", "plan_id"])


@query
def stream_windows(spark, sf):
    """Events per type and hour: a stream for the hours that the watermark closes, then a batch pass for the rest."""
    out, state = new_folder(spark, "windows"), new_folder(spark, "windows-state")
    schema = B.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    columns = [F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("plan_id")]
    windows = R.proposals_per_window(rows.select(*columns), width="1 hour", lateness="10 minutes")
    R.write_appends(windows, out, state).awaitTermination()
    closed = spark.read.schema(windows.schema).parquet(out)
    done = R.complete_windows(closed, B.table(spark, sf, "events").select(*columns), width="1 hour")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_late_rows(spark, sf):
    """Events per type and hour, where every tenth event comes with the last of four files, however old it is."""
    path, out, state = (new_folder(spark, n) for n in ("event-files", "windows", "windows-state"))
    events = B.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("plan_id"), "event_id")
    quarter = F.when(F.col("event_id") % 10 == 0, 3).otherwise(F.floor((F.dayofmonth("ts") - 1) / 8))
    for number in range(4):  # files are taken in the order in which they were written
        events.where(quarter == number).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    R.write_windows(rows, out, state, width="1 hour").awaitTermination()
    done = R.counted_windows(spark, out, width="1 hour")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_dedupe(spark, sf):
    """Log rows of a log in which two batches were appended twice."""
    path, out, state = (new_folder(spark, n) for n in ("log-files", "rows", "rows-state"))
    rows = J.log_rows(_log(spark, sf))
    rows.unionByName(rows.where(F.col("batch").isin(2, 5))).repartition(4).write.partitionBy("run_id").json(path)
    unique = R.deduplicated(R.log_stream(spark, path, files_per_batch=3), "30 days").select("run_id", "iter", "plan_id")
    R.write_appends(unique, out, state).awaitTermination()
    return spark.read.schema(unique.schema).parquet(out)


def _stream_scores(spark, sf, scorer) -> tuple[DataFrame, DataFrame, str]:
    path, cache, state = (new_folder(spark, n) for n in ("artifact-files", "stream-cache", "stream-state"))
    arts, exs = B.distinct_artifacts(spark, sf), B.examples(spark, sf)
    arts.repartition(3).write.parquet(path)
    arriving = spark.readStream.schema(arts.schema).option("maxFilesPerTrigger", 2).parquet(path)
    RS.stream_scores(arriving, exs, scorer, cache, state).awaitTermination()
    return arts, exs, cache


@query
def stream_score(spark, sf):
    """Metrics after artifacts arrived in files and were scored as they came."""
    arts, exs, cache = _stream_scores(spark, sf, B.hash_scorer_function)
    failed = settle(RS.failed_predictions(spark, cache), "failed")
    results = C.scoring_results(exs, failed, arts, RS.read_stream_cache(spark, cache))
    return rounded(results, 9, *METRICS).select("run_id", "artifact_hash", "split", *METRICS)


@query
def stream_score_failures(spark, sf):
    """The same with a scorer that refuses some artifacts: their groups fail and say why."""
    arts, exs, cache = _stream_scores(spark, sf, _failing_scorer)
    failed = settle(RS.failed_predictions(spark, cache), "failed")
    results = C.scoring_results(exs, failed, arts, RS.read_stream_cache(spark, cache))
    return rounded(results, 9, *METRICS)
