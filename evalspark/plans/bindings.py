"""The data model on the supplied tables.

Labelled examples are ``documents`` with ``labels``, one run per language and one stratum per
source; artifacts are the ``benchmark`` texts, proposed in every run; predictions come from the
deterministic hash scorer; the log is built from their metrics. ``lineitem`` gives a large
prediction table. Responses, selections and notebooks wrap the texts of ``conversations``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.hashing import sha16
from evalspark.operators.log import build_entries
from evalspark.operators.metrics import all_metrics
from evalspark.operators.scoring import hash_scorer, score_pairs
from evalspark.operators.splits import hash_split
from evalspark.plans.shared import settle

RUNS = ("de", "en", "es", "fr")
LABEL_ORDER = {"A": 1, "N": 2, "R": 3}
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table that is durable in practice (predictions, log): built once per session, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _stored:
        _stored[key] = settle(build(spark, sf_dir), build.__name__)
    return _stored[key]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("lang").alias("run_id"), F.col("doc_id").alias("id"), F.col("text").alias("input"),
        F.col("quality").cast("string").alias("label"), F.col("source").alias("domain"),
    )
    return hash_split(rows)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    minutes = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(item_id as int))")
    return table(spark, sf_dir, "benchmark").select(
        F.explode(F.array(*[F.lit(r) for r in RUNS])).alias("run_id"),
        (item + 1).alias("iter"),
        (F.floor(item / 5) + 1).alias("batch"),
        F.replace(minutes.cast("string"), F.lit(" "), F.lit("T")).alias("ts"),
        sha16("text").alias("artifact_hash"),
        F.nullif(F.floor((item + 1) / 2), F.lit(0)).alias("parent"),
        F.concat(F.lit("plan_"), (item % 7).cast("string")).alias("plan_id"),
        F.concat(F.lit("Change "), item.cast("string"), F.lit(": "), F.col("text")).alias("rationale"),
        F.col("text").alias("artifact"),
        F.when(item % 3 == 0, F.concat(F.lit("Errors seen before "), item.cast("string"))).alias("stage_a_summary"),
    )


def distinct_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).select("run_id", "artifact_hash", "artifact").distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-scored pairs, without any text."""
    names = distinct_artifacts(spark, sf_dir).select("run_id", "artifact_hash")
    lines = examples(spark, sf_dir).select("run_id", "split", "id", "label")
    pairs = score_pairs(names, lines, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return hash_scorer(pairs).select("run_id", "artifact_hash", "split", "id", "label", "prediction")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment log: every proposed artifact with its metrics on the three splits."""
    metrics = all_metrics(stored(spark, sf_dir, predictions))
    return build_entries(metrics, artifacts(spark, sf_dir))


def log_without_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, computed from the tables in one go."""
    return build_entries(all_metrics(predictions(spark, sf_dir)), artifacts(spark, sf_dir))


def big_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per line item, three ordinal classes."""
    other = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    right = (7 * F.col("l_orderkey") + 13 * F.col("l_linenumber")) % 10 < 7
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("run_id"),
        F.concat_ws(":", "l_linestatus", F.col("l_linenumber").cast("string")).alias("artifact_hash"),
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("label"),
        F.when(right, F.col("l_returnflag")).otherwise(other).alias("prediction"),
    )
    return hash_split(rows)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal response per conversation turn, in four shapes."""
    text, role = F.col("text"), F.col("role")
    plan = (F.col("conv_id") % 7).cast("string")
    full = F.concat(
        F.lit("Here are the candidates.\n--- CANDIDATE ---\nplan_id: plan_"), plan, F.lit("\nrationale: "), text,
        F.lit("\nIt helps.\n<PROMPT>\n"), text, F.lit("\nAnswer as "), role, F.lit(".\n</PROMPT>\n"),
        F.lit("--- CANDIDATE ---\nplan_id: no_body\nrationale: nothing to show\n"),
        F.lit("--- CANDIDATE ---\nrationale: no plan for "), role, F.lit("\n<PROMPT>"), role, F.lit(": "), text, F.lit("</PROMPT>"),
    )
    shape = F.col("turn") % 4
    body = (
        F.when(shape == 0, full)
        .when(shape == 1, F.concat(F.lit("<think>"), text))
        .when(shape == 2, F.concat(F.lit("<Think>"), role, F.lit("</Think>\n"), full))
        .otherwise(F.concat(F.lit("--- CANDIDATE ---\nplan_id: open\n<PROMPT>\n"), text))
    )
    run = F.element_at(F.array(*[F.lit(r) for r in RUNS]), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", run.alias("run_id"), role.alias("role"), body.alias("text")
    )


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the responses, numbered by conversation, turn and position."""
    from evalspark.operators.extract import extract_candidates

    found = extract_candidates(responses(spark, sf_dir))
    at = F.col("conv_id") * 100_000_000 + F.col("turn") * 10_000 + F.col("position")
    return found.withColumn("candidate_id", at)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection response per conversation turn, in five shapes."""
    one = (F.col("conv_id") % 40 + 1).cast("string")
    two = ((F.col("conv_id") + F.col("turn")) % 40 + 1).cast("string")
    shape = F.col("turn") % 5
    body = (
        F.when(shape == 0, F.concat(F.lit('I choose "iter='), one, F.lit('" because: '), F.col("role"), F.lit(" said so.\nMore.")))
        .when(shape == 1, F.concat(F.lit("merge="), one, F.lit(","), two, F.lit("\nReason: both are good")))
        .when(shape == 2, F.concat(F.lit("merge="), one, F.lit(", "), two, F.lit(", 9999")))
        .when(shape == 3, F.concat(F.lit("merge="), two, F.lit(" or iter="), one, F.lit(" RATIONALE "), F.col("text")))
        .otherwise(F.concat(F.lit("No idea. "), F.col("role")))
    )
    run = F.element_at(F.array(*[F.lit(r) for r in RUNS]), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        run.alias("run_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("selection_id"), body.alias("text")
    )


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One merge response per benchmark text."""
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.concat(
            F.lit("--- MERGE ---\nrationale: parts of "), F.col("item_id").cast("string"), F.lit("\nand others\n<PROMPT>\n\n"),
            F.col("text"), F.lit("\nEnd.\n\n</PROMPT>\n"),
        ).alias("text"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notebook per conversation turn."""
    text, role = F.col("text"), F.col("role")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("note_id"),
        F.concat(
            F.lit("# Notebook\n\n## USER\n\n"), text, F.lit("\n### detail\n"), role, F.lit("\n\n## OBSERVATION\n\n"), text,
            F.lit("\n## USER\n  \n## USERS\nnot of the user\n## USER second\n- keep it short\n\n"), role,
        ).alias("text"),
    )


def banned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms the user bans: the first word and the first two words of every benchmark text."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        F.explode(F.array(words[0], F.concat_ws(" ", words[0], words[1]))).alias("term")
    ).distinct()


def hash_scorer_function(artifact: str, chunk: pd.DataFrame, temperature: float) -> list[str]:
    """The hash scorer as a user's scorer function."""
    name = hashlib.sha256(artifact.encode()).hexdigest()[: fixed.ARTIFACT_HASH_LENGTH]
    accuracy = min(
        fixed.HASH_SCORER_CEILING,
        fixed.HASH_SCORER_BASE + fixed.HASH_SCORER_STEP * (int(name[:8], 16) % fixed.HASH_SCORER_MODULUS),
    )
    draws = (int(hashlib.sha256(f"{name}:{i}".encode()).hexdigest()[:8], 16) % 1000 for i in chunk["id"])
    return [y if d < accuracy else fixed.WRONG_PREFIX + y for d, y in zip(draws, chunk["label"])]


def flaky_scorer_function(artifact: str, chunk: pd.DataFrame, temperature: float) -> list[str | None]:
    """The hash scorer, failing on a third of the examples per attempt."""
    name = hashlib.sha256(artifact.encode()).hexdigest()[: fixed.ARTIFACT_HASH_LENGTH]
    tenths = round(temperature * 10)
    fails = (
        int(hashlib.sha256(f"{name}:{i}:{tenths}".encode()).hexdigest()[:8], 16) % 3 == 0 for i in chunk["id"]
    )
    return [None if f else y for f, y in zip(fails, hash_scorer_function(artifact, chunk, temperature))]
