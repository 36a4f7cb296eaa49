"""The experiment log as a stream of appended files.

Stateful aggregations run in update mode and write each micro-batch's changed groups to a folder
of their own, so a repeated micro-batch overwrites itself. Readers take the newest row per key, of
a generation that holds all older changes and of the changes since.

Windows can also be counted with their late rows: each micro-batch splits its rows at the watermark,
and what comes behind it corrects the closed windows by deltas.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.numbers import or_zero
from evalspark.operators.keys import join_on
from evalspark.operators.ranking import running
from evalspark.sources.jsonl import flat_log
from evalspark.sources.schemas import LOG_ROW


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Log rows as their files arrive, with wide metrics and ``ts`` as event time."""
    rows = spark.readStream.schema(LOG_ROW).option("maxFilesPerTrigger", files_per_batch).json(path)
    return flat_log(rows).withColumn("ts", F.col("ts").cast("timestamp"))


def write_upserts(aggregate: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), compact_every: int = 100) -> StreamingQuery:
    """Start an update-mode aggregation that writes its changed groups per micro-batch.

    With the ``keys`` of its groups, every ``compact_every`` micro-batches the newest rows become one generation.
    """
    return (
        aggregate.writeStream.outputMode("update").foreachBatch(lambda changed, batch: upsert(changed, batch, path, keys, compact_every))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert(changed: DataFrame, batch: int, path: str, keys: Sequence[str] = (), compact_every: int = 100) -> None:
    """Write the changed groups of a micro-batch, to a folder of their own."""
    changed.write.mode("overwrite").parquet(f"{path}/changes/micro_batch={batch}")
    if keys and (batch + 1) % compact_every == 0:
        compact_upserts(changed.sparkSession, path, keys, batch)


def compact_upserts(spark: SparkSession, path: str, keys: Sequence[str], batch: int) -> None:
    """Write the newest row of every key up to a micro-batch as a generation, then the pointer to it.

    Only then are the generation before it and the changes that it held deleted, so a job that ends at any point leaves a
    whole generation behind, and the number of files stays bounded.
    """
    held = _generation(spark, path)
    if held >= batch:
        return
    newest = read_upserts(spark, path, keys, batch)
    newest.withColumn("micro_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/generations/upto={batch}")
    spark.createDataFrame([(batch,)], "upto bigint").write.mode("overwrite").parquet(f"{path}/pointer/at={batch}")
    for folder, key, last in ((f"{path}/changes", "micro_batch", batch), (f"{path}/generations", "upto", held), (f"{path}/pointer", "at", held)):
        _delete(spark, folder, key, last)


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop knows them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _delete(spark: SparkSession, path: str, key: str, last: int) -> None:
    """Delete the folders ``key=n`` with n up to ``last``."""
    files, folder = _folder(spark, path)
    for found in files.listStatus(folder) if files.exists(folder) else ():
        name, _, number = found.getPath().getName().partition("=")
        if name == key and int(number) <= last:
            files.delete(found.getPath(), True)


def _generation(spark: SparkSession, path: str) -> int:
    """Micro-batch up to which the newest whole generation goes; -1 without one."""
    files, folder = _folder(spark, f"{path}/pointer")
    if not files.exists(folder):
        return -1
    return spark.read.schema("upto bigint, at bigint").parquet(f"{path}/pointer").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], last: int | None = None) -> DataFrame:
    """The newest values of every key: of the newest generation and the changes after it (up to a micro-batch)."""
    held, parts = _generation(spark, path), []
    files, folder = _folder(spark, f"{path}/changes")
    if held >= 0:
        parts.append(spark.read.parquet(f"{path}/generations/upto={held}"))
    if files.exists(folder) and len(files.listStatus(folder)):
        later = F.col("micro_batch") > held
        changes = spark.read.parquet(f"{path}/changes").withColumn("micro_batch", F.col("micro_batch").cast("bigint"))
        parts.append(changes.where(later if last is None else later & (F.col("micro_batch") <= last)))
    rows = reduce(DataFrame.unionByName, parts)
    values = [c for c in rows.columns if c not in (*keys, "micro_batch")]
    newest = F.max_by(F.struct(*values), "micro_batch").alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"v.{c}" for c in values])


def batch_progress(log: DataFrame) -> DataFrame:
    """Entries and best dev kappa per batch (streaming or not)."""
    return log.groupBy("run_id", "batch").agg(
        F.count(F.lit(1)).alias("entries"), F.max(or_zero("kappa_dev")).alias("best_kappa_dev")
    )


def plan_counts(log: DataFrame) -> DataFrame:
    """Proposals per plan (streaming or not)."""
    return log.groupBy("run_id", "plan_id").agg(F.count(F.lit(1)).alias("proposed"))


def best_so_far(progress: DataFrame) -> DataFrame:
    """Running best over the batches; a finished table, since streams have no running windows."""
    return running(progress, ["run_id"], "batch", maxima={"best_so_far": F.col("best_kappa_dev")})


def proposals_per_window(
    rows: DataFrame, plan: str = "plan_id", width: str = "1 minute", lateness: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Proposals per plan and event-time window; windows are emitted once the watermark passes them."""
    window: Column = F.window(ts, width)
    return (
        rows.withWatermark(ts, lateness).groupBy(window.alias("w"), plan)
        .agg(F.count(F.lit(1)).alias("proposals"))
        .select(F.col("w.start").alias("window_start"), plan, "proposals")
    )


def complete_windows(closed: DataFrame, rows: DataFrame, plan: str = "plan_id", width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """The batch pass that ends a replay: proposals of every window over all rows.

    ``unstreamed`` are those the stream has not counted, in windows still open at its end or behind
    the watermark.
    """
    every = rows.groupBy(F.window(ts, width).alias("w"), plan).agg(F.count(F.lit(1)).alias("proposals"))
    every = every.select(F.col("w.start").alias("window_start"), plan, "proposals")
    streamed = closed.groupBy("window_start", plan).agg(F.sum("proposals").alias("_streamed"))
    joined = join_on(every, streamed, ["window_start", plan], "left", null_safe=True)
    return joined.select("window_start", plan, "proposals", (F.col("proposals") - F.coalesce("_streamed", F.lit(0))).alias("unstreamed"))


def write_windows(
    rows: DataFrame, path: str, checkpoint: str, plan: str = "plan_id", width: str = "1 minute", lateness: str = "10 minutes", ts: str = "ts"
) -> StreamingQuery:
    """Start a stream that counts rows per plan and window, rows behind the watermark apart.

    The watermark of a micro-batch is the newest time in the ones before it, less the lateness, as Spark has it; a row is
    late if its window had ended by then. A micro-batch writes its counts (deltas, which add up), its late rows and its
    newest time to folders of its own. No row is read again, however late it comes, and no state is held.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], "newest timestamp").write.mode("ignore").parquet(f"{path}/newest/micro_batch=-1")

    def split(part: DataFrame, batch: int) -> None:
        before = spark.read.schema("micro_batch bigint, newest timestamp").parquet(f"{path}/newest").where(F.col("micro_batch") < batch)
        newest = before.agg(F.max(F.unix_micros("newest"))).first()[0]
        start = F.window(ts, width)
        passed = F.timestamp_micros(F.lit(newest).cast("bigint")) - F.expr(f"INTERVAL {lateness}")
        late = F.coalesce(start["end"] <= passed, F.lit(False))
        marked = part.where(F.col(ts).isNotNull()).withColumn("late", late).withColumn("window_start", start["start"])
        counts = marked.groupBy("window_start", plan).agg(F.count_if(~F.col("late")).alias("in_time"), F.count_if("late").alias("late"))
        counts.write.mode("overwrite").parquet(f"{path}/deltas/micro_batch={batch}")
        marked.where("late").drop("late", "window_start").write.mode("overwrite").parquet(f"{path}/late/micro_batch={batch}")
        part.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/micro_batch={batch}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came behind the watermark, with the micro-batch that brought them."""
    return spark.read.parquet(f"{path}/late")


def counted_windows(
    spark: SparkSession, path: str, plan: str = "plan_id", width: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """``window_start, plan, proposals, unstreamed, closed`` so far: all rows of a window, those of them that came after it
    had closed, and whether the watermark has passed it. Only the deltas are read."""
    counts = spark.read.parquet(f"{path}/deltas").groupBy("window_start", plan).agg(F.sum("in_time").alias("_in"), F.sum("late").alias("unstreamed"))
    newest = spark.read.parquet(f"{path}/newest").agg(F.max("newest")).scalar()
    closed = F.col("window_start") + F.expr(f"INTERVAL {width}") <= newest - F.expr(f"INTERVAL {lateness}")
    return counts.select("window_start", plan, (F.col("_in") + F.col("unstreamed")).alias("proposals"), "unstreamed", closed.alias("closed"))


def deduplicated(rows: DataFrame, horizon: str, keys: Sequence[str] = ("run_id", "iter")) -> DataFrame:
    """Log rows without the copies a resumed writer appends.

    The horizon is the span of event time that may be replayed; it bounds the state. Rows further
    behind the newest are dropped by the watermark, so it must cover the whole replay.
    """
    return rows.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(list(keys))


def write_appends(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start an append-mode stream into parquet files (exactly once by the file sink's log)."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
