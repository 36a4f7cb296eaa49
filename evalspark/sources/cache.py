"""The prediction cache: an append-only table keyed by content hash, split and example.

Only successful predictions are cached. A retried job may append the same key twice. Looking a key
up does not mind; ``one_per_pair`` collapses the copies, and is applied after the rows wanted have
been picked, so the whole cache is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.operators.keys import join_on
from evalspark.operators.ledger import ledger_of
from evalspark.operators.scoring import SCORED, Scorer, last_attempts, pending_work, score, score_with_retries, scoring_results
from evalspark.plans.shared import settle
from evalspark.sources.schemas import LEDGER, PREDICTION


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PREDICTION)


def append_cache(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Append the rows without an error, and then their bits to the ledger beside the cache.

    ``scored`` is read twice. A job that ends between the two leaves rows whose bits are missing: they are
    scored again, and copies collapse.
    """
    good = scored.where(F.col("error").isNull())
    good.select("artifact_hash", "split", "id", "prediction", "run_id").write.mode(mode).partitionBy("run_id").parquet(path)
    bits = ledger_of(good).select("artifact_hash", "split", "bucket", "bits", "run_id")
    bits.write.mode(mode).partitionBy("run_id").parquet(_ledger_path(path))


def _ledger_path(path: str) -> str:
    return f"{path.rstrip('/')}-ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of the cache at ``path``, one row per append and key; a filter on ``run_id`` prunes folders."""
    return spark.read.schema(LEDGER).parquet(_ledger_path(path))


def rebuild_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Write the ledger anew from the cache's rows, with one row per key, and return it."""
    bits = settle(ledger_of(read_cache(spark, path)), "ledger")
    bits.select("artifact_hash", "split", "bucket", "bits", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(_ledger_path(path))
    return read_ledger(spark, path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached rows, copies included; a filter on ``run_id`` prunes folders."""
    return spark.read.schema(PREDICTION).parquet(path)


def append_artifacts(artifacts: DataFrame, path: str) -> None:
    """Keep the texts beside the predictions, so that the cache explains itself."""
    artifacts.select("artifact_hash", "artifact").dropDuplicates(["artifact_hash"]).write.mode("append").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The texts of all artifacts that were ever scored, one row per hash."""
    return spark.read.schema("artifact_hash string, artifact string").parquet(path).dropDuplicates(["artifact_hash"])


def score_artifacts(
    artifacts: DataFrame,
    examples: DataFrame,
    scorer: Scorer,
    cache: DataFrame,
    cache_path: str | None = None,
    tasks: int | None = None,
    retries: bool = False,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Score what is pending, extend the cache, and return metrics per run, artifact and split.

    The scored rows are written before anything reads them, so each pair is sent to the scorer by
    one job only, whatever is computed from its answer. The cached rows in question are written too,
    so rows appended to the cache below are never counted twice. With ``retries`` a failed pair is
    tried again at the next temperatures. With the cache's ``ledger`` its rows are not looked through for what is pending.
    """
    work = pending_work(artifacts, examples, cache, tasks, ledger)
    answers = last_attempts(score_with_retries(work, scorer)).select(*StructType.fromDDL(SCORED).names) if retries else score(work, scorer)
    scored = settle(answers, "scored")
    cache = settle(join_on(cache, artifacts.select("run_id", "artifact_hash").distinct(), ["run_id", "artifact_hash"], "left_semi"), "cached")
    if cache_path:
        append_cache(scored, cache_path)
        append_artifacts(artifacts, f"{cache_path}-artifacts")
    return scoring_results(examples, scored, artifacts, cache)
