"""Where predictions and labels disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.numbers import ratio
from evalspark.operators.keys import join_on
from evalspark.operators.metrics import KEYS, contingency


def disagreements(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("label").eqNullSafe(F.col("prediction")))


def _with_inputs(samples: DataFrame, examples: DataFrame, chars: int) -> DataFrame:
    """Add the inputs, cut to ``chars`` characters, to the few sampled rows."""
    inputs = examples.select("run_id", "id", F.substring("input", 1, chars).alias("input"))
    return join_on(samples, inputs, ["run_id", "id"], "left")


def error_samples(
    predictions: DataFrame,
    examples: DataFrame,
    n_samples: int = fixed.ERROR_SAMPLES,
    keys: Sequence[str] = KEYS,
    chars: int = fixed.ERROR_INPUT_CHARS,
) -> DataFrame:
    """The first disagreements of every group in example order.

    Only the first ``n_samples`` rows of a group in each input partition reach the shuffle (Spark
    limits the groups of a row-number filter before it), and texts join after the choice.
    """
    order = Window.partitionBy(*keys).orderBy("id")
    first = (
        disagreements(predictions)
        .select(*keys, "id", "prediction", "label")
        .withColumn("sample", F.row_number().over(order).cast("bigint"))
        .where(F.col("sample") <= n_samples)
    )
    return _with_inputs(first, examples, chars)


def error_types(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count and share of every kind of disagreement (label, prediction) in a group."""
    cells = disagreements(contingency(predictions, keys))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return cells.select(*keys, "label", "prediction", "n", ratio(F.col("n"), total).alias("share"))


def balanced_errors(
    predictions: DataFrame,
    examples: DataFrame,
    n_samples: int = fixed.ERROR_SAMPLES,
    keys: Sequence[str] = KEYS,
    chars: int = fixed.ERROR_INPUT_CHARS,
) -> DataFrame:
    """Disagreements taken in turns from the kinds of error, frequent kinds first.

    Both row-number filters are limited before their shuffles: no kind gives more than
    ``n_samples`` rows, whatever its size.
    """
    kind = [*keys, "label", "prediction"]
    first = (
        disagreements(predictions)
        .select(*kind, "id")
        .withColumn("turn", F.row_number().over(Window.partitionBy(*kind).orderBy("id")).cast("bigint"))
        .where(F.col("turn") <= n_samples)
    )
    sizes = disagreements(contingency(predictions, keys)).withColumnRenamed("n", "kind_rows")
    order = Window.partitionBy(*keys).orderBy("turn", F.desc("kind_rows"), "id")
    chosen = (
        join_on(first, sizes, kind, null_safe=True)
        .withColumn("sample", F.row_number().over(order).cast("bigint"))
        .where(F.col("sample") <= n_samples)
    )
    return _with_inputs(chosen, examples, chars)


def _digest_entry(row: Column) -> Column:
    shown = [F.coalesce(row[c], F.lit(fixed.MISSING)) for c in ("input", "prediction", "label")]
    return F.format_string(fixed.DIGEST_ENTRY, row["sample"], *shown)


def error_digest(samples: DataFrame, keys: Sequence[str] = KEYS, limit: int = fixed.ERROR_SAMPLES) -> DataFrame:
    """The first ``limit`` samples of a group, numbered, as one text."""
    rows = F.sort_array(
        F.collect_list(
            F.struct("sample", F.substring("input", 1, fixed.DIGEST_INPUT_CHARS).alias("input"), "prediction", "label")
        )
    )
    few = samples.where(F.col("sample") <= limit)
    return few.groupBy(*keys).agg(rows.alias("rows")).select(
        *keys, F.array_join(F.transform("rows", _digest_entry), "").alias("digest")
    )
