"""Incremental scoring: artifacts arrive as files, only pairs without a prediction are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evalspark.operators.keys import join_on
from evalspark.operators.scoring import PAIR_KEY, Scorer, one_per_pair, pending_work, score
from evalspark.plans.shared import settle
from evalspark.sources.cache import empty_cache
from evalspark.sources.schemas import PREDICTION

FAILED = "run_id string, artifact_hash string, artifact string, split string, id bigint, label string, error string"


def stream_scores(
    arriving: DataFrame, examples: DataFrame, scorer: Scorer, cache_path: str, checkpoint: str
) -> StreamingQuery:
    """Score a stream of artifacts (``run_id, artifact_hash, artifact``) against fixed examples.

    A micro-batch writes to its own folder of the cache and looks only at the other folders, so a
    repeated micro-batch computes the same rows and overwrites them. Pairs that failed go to a
    table of errors beside the cache; later micro-batches try them again (``failed_predictions``).
    """
    spark = arriving.sparkSession
    empty_cache(spark).write.mode("ignore").parquet(f"{cache_path}/micro_batch=-1")
    spark.createDataFrame([], FAILED).write.mode("ignore").parquet(f"{_errors(cache_path)}/micro_batch=-1")

    def score_batch(artifacts: DataFrame, batch: int) -> None:
        other = F.col("micro_batch") != batch
        again = spark.read.schema(f"{FAILED}, micro_batch bigint").parquet(_errors(cache_path)).where(other)
        columns = ["run_id", "artifact_hash", "artifact"]
        artifacts = settle(artifacts.select(*columns).unionByName(again.select(*columns)).distinct(), "arrived")
        cache = read_stream_cache(spark, cache_path).where(other)
        scored = settle(score(pending_work(artifacts, examples, cache), scorer), "scored")
        bad = join_on(scored.where(F.col("error").isNotNull()), artifacts, ["run_id", "artifact_hash"])
        bad.select(*[f.name for f in StructType.fromDDL(FAILED).fields]).write.mode("overwrite").parquet(f"{_errors(cache_path)}/micro_batch={batch}")
        good = scored.where(F.col("error").isNull()).select("artifact_hash", "split", "id", "prediction", "run_id")
        good.write.mode("overwrite").parquet(f"{cache_path}/micro_batch={batch}")

    return (
        arriving.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _errors(cache_path: str) -> str:
    return f"{cache_path.rstrip('/')}-errors"


def failed_predictions(spark, cache_path: str) -> DataFrame:
    """The newest error of every pair that has no prediction yet, as scored rows."""
    rows = spark.read.schema(f"{FAILED}, micro_batch bigint").parquet(_errors(cache_path)).repartition(*PAIR_KEY)
    newest = rows.groupBy(*PAIR_KEY).agg(F.max_by(F.struct("label", "error"), "micro_batch").alias("v"))
    # The cache is small as files only, so it is never broadcast.
    rest = join_on(newest, read_stream_cache(spark, cache_path).select(*PAIR_KEY).hint("merge"), list(PAIR_KEY), "left_anti")
    return rest.select(*PAIR_KEY, "v.label", F.lit(None).cast("string").alias("prediction"), "v.error")


def read_stream_cache(spark, cache_path: str) -> DataFrame:
    """The streamed cache with the micro-batch of each row."""
    return spark.read.schema(f"{PREDICTION}, micro_batch bigint").parquet(cache_path)


def cached_predictions(spark, cache_path: str) -> DataFrame:
    return one_per_pair(read_stream_cache(spark, cache_path))
