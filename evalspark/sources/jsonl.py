"""JSON lines: labelled examples, splits, scorer output and the experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.functions import fixed
from evalspark.operators.keys import join_on
from evalspark.operators.metrics import flat_metrics, metrics_map
from evalspark.sources.schemas import CORRUPT, EXAMPLE, LOG_ROW


def _scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad lines land in ``_corrupt``."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_examples(
    spark: SparkSession, path: str, schema: str = EXAMPLE, bad_lines: str = "fail", other_keys: str | None = None
) -> DataFrame:
    """Labelled examples; the label is ``label``, else ``ground_truth``, else ``''``.

    A line that is no JSON object or does not fit ``schema`` fails the job that reads it; with
    ``bad_lines="skip"`` it is left out, and ``bad_example_lines`` gives those lines. Other keys
    are kept by naming them in ``schema``, or all together as a map column named ``other_keys``.
    """
    rows = _example_lines(spark, path, schema)
    good = F.col(f"_row.{CORRUPT}").isNull()
    if bad_lines == "fail":
        message = F.concat(F.lit("bad example line: "), F.substring("value", 1, 200))
        good = F.when(good, True).otherwise(F.raise_error(message).cast("boolean"))
    rest = []
    if other_keys:
        named = [f.name for f in StructType.fromDDL(schema).fields]
        every = F.from_json("value", "map<string,string>")
        rest = [F.map_filter(every, lambda k, _: ~k.isin(named)).alias(other_keys)]
    rows = rows.where(good).select("_row.*", *rest)
    return rows.withColumn("label", F.coalesce("label", "ground_truth", F.lit(""))).drop("ground_truth", CORRUPT)


def bad_example_lines(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """``file, line`` of the lines that ``read_examples`` cannot use."""
    bad = _example_lines(spark, path, schema).where(F.col(f"_row.{CORRUPT}").isNotNull())
    return bad.select("file", F.col("value").alias("line"))


def _example_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are not blank, as ``file, value`` and a parsed ``_row`` that names what does not fit."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("_row"))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per split."""
    df.write.partitionBy("split").mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str, schema: str = "id bigint, input string, label string, domain string") -> DataFrame:
    return spark.read.schema(f"{schema}, split string").json(path)


def parse_scorer_output(lines: DataFrame, line: str = "line") -> DataFrame:
    """One prediction per scorer output line.

    A JSON object gives its ``prediction``, else its ``label``, else ``''``; any other line is
    itself the prediction. Empty lines are skipped.
    """
    text = F.col(line)
    is_object = F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    keys = F.when(is_object, F.json_object_keys(text))
    picked = (
        F.when(F.array_contains(keys, "prediction"), F.get_json_object(text, "$.prediction"))
        .when(F.array_contains(keys, "label"), F.get_json_object(text, "$.label"))
    )
    prediction = F.when(is_object, F.coalesce(picked, F.lit(""))).otherwise(text)
    return lines.where(text != "").withColumn("prediction", prediction).drop(line)


# The experiment log --------------------------------------------------------------------------


def log_rows(wide: DataFrame) -> DataFrame:
    """Log entries with wide metrics as rows with one metric map per split."""
    maps = {f"metrics_{s}": metrics_map(f"_{s}") for s in fixed.SPLITS}
    return wide.withColumns(maps).selectExpr(
        "run_id", "iter", "batch", "ts", "artifact_hash", "parent", "plan_id", "rationale", "artifact",
        *maps, "stage_a_summary",
    )


def flat_log(rows: DataFrame) -> DataFrame:
    """Log rows with their metric maps as wide columns."""
    kept = [c for c in rows.columns if not c.startswith("metrics_")]
    return rows.select(*kept, *[c for s in fixed.SPLITS for c in flat_metrics(f"metrics_{s}", f"_{s}")])


def append_log(rows: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append log rows; rows whose (run, iteration) is in ``existing`` are left out.

    Files are only ever added, so earlier rows are never rewritten, and appending the same rows
    again after a crash adds nothing. Of several rows with one key in ``rows`` one is written.
    """
    row = F.struct("*")
    rows = rows.groupBy("run_id", "iter").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    if existing is not None:
        rows = join_on(rows, existing.select("run_id", "iter"), ["run_id", "iter"], "left_anti")
    rows.write.mode("append").partitionBy("run_id").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows that are valid JSON; keys outside the schema are ignored."""
    return _scan(spark, path, LOG_ROW).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def log_integrity(spark: SparkSession, path: str) -> DataFrame:
    """Per file: valid and corrupt lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    valid = F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.sum(valid.cast("int")).alias("valid"), F.sum((~valid).cast("int")).alias("corrupt")
    )


def duplicate_entries(log: DataFrame) -> DataFrame:
    """Entries that stand in the log more than once."""
    return log.groupBy("run_id", "iter").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def log_rewrites(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the older snapshot that are not in the newer one as they were.

    Rows are compared by a digest of all their columns, so only keys and digests are shuffled.
    """
    digest = F.sha2(F.to_json(F.struct(*old.columns), {"ignoreNullFields": "false"}), 256).alias("digest")
    narrow = lambda df: df.select("run_id", "iter", digest)
    return narrow(old).exceptAll(narrow(new)).select("run_id", "iter")
