"""Agreement metrics from one contingency aggregation.

Predictions are counted once per (group, label, prediction); map-side aggregation collapses a hot
group before anything is shuffled. Kappa and rho are computed from those cells in exact integers up
to the final division; macro-F1 averages the exact ratios of the classes as doubles, whose last bit
can depend on the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.numbers import decimals, exact, or_zero, ratio, to_number
from evalspark.operators.keys import join_on
from evalspark.operators.ranking import average_ranks
from evalspark.plans.shared import settle

KEYS = ("run_id", "artifact_hash", "split")


def contingency(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per group, label and prediction."""
    return predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per class of a group: times labelled, times predicted, times both."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("labelled"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("labelled"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    return (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.class")
        .agg(
            F.sum("s.labelled").alias("labelled"),
            F.sum("s.predicted").alias("predicted"),
            F.sum("s.hits").alias("hits"),
        )
    )


def _kappa(rows: Column, hits: Column, chance: Column) -> Column:
    """(N * hits - sum r*c) / (N^2 - sum r*c); 0.0 where every row is of one shared class."""
    rows, hits = exact(rows), exact(hits)
    return ratio(rows * hits - chance, rows * rows - chance)


def _f1(hits: Column, labelled: Column, predicted: Column) -> Column:
    return ratio(2 * hits, labelled + predicted)


def kappa_and_f1(classes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cohen's kappa (unweighted) and macro-F1 over the union of label and prediction classes."""
    return (
        classes.groupBy(*keys)
        .agg(
            F.sum("labelled").alias("rows"),
            F.sum("hits").alias("hits"),
            F.sum(exact("labelled") * exact("predicted")).alias("chance"),
            F.avg(_f1(F.col("hits"), F.col("labelled"), F.col("predicted"))).alias("f1"),
        )
        .select(
            *keys,
            F.col("rows").alias("n"),
            _kappa(F.col("rows"), F.col("hits"), F.col("chance")).alias("kappa"),
            "f1",
        )
    )


def _with_all_groups(metrics: DataFrame, groups: DataFrame | None, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Groups without any prediction have metrics of 0.0."""
    if groups is None:
        return metrics
    joined = join_on(groups.select(*keys).distinct(), metrics, keys, "left", null_safe=True)
    return joined.select(*keys, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])


def cohen_kappa(predictions: DataFrame, keys: Sequence[str] = KEYS, groups: DataFrame | None = None) -> DataFrame:
    found = kappa_and_f1(class_counts(contingency(predictions, keys), keys), keys).select(*keys, "kappa")
    return _with_all_groups(found, groups, keys, ["kappa"])


def macro_f1(predictions: DataFrame, keys: Sequence[str] = KEYS, groups: DataFrame | None = None) -> DataFrame:
    found = kappa_and_f1(class_counts(contingency(predictions, keys), keys), keys).select(*keys, "f1")
    return _with_all_groups(found, groups, keys, ["f1"])


def confusion_matrix(predictions: DataFrame, classes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide contingency: one row per group and label, one column per class predicted.

    ``predicted_other`` counts predictions that are null or of no listed class, so a row adds up to its label's rows.
    """
    given = [F.col("prediction") == F.lit(c) for c in classes]
    listed = F.coalesce(F.col("prediction").isin(list(classes)), F.lit(False))
    return predictions.groupBy(*keys, "label").agg(
        *[F.count_if(hit).alias(f"predicted_{c}") for c, hit in zip(classes, given, strict=True)], F.count_if(~listed).alias("predicted_other")
    )


def per_class_report(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall, F1 and support of every class of a group."""
    classes = class_counts(contingency(predictions, keys), keys)
    return classes.select(
        *keys, "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("labelled")).alias("recall"),
        _f1(F.col("hits"), F.col("labelled"), F.col("predicted")).alias("f1"),
        F.col("labelled").alias("support"),
    )


def combined_kappa(
    predictions: DataFrame,
    combinations: Mapping[str, Sequence[str]],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Kappa per split and per combination of splits, from the cells of the single splits."""
    cells = contingency(predictions, keys)
    names = F.array_compact(
        F.array(F.col("split"), *[F.when(F.col("split").isin(*splits), F.lit(n)) for n, splits in combinations.items()])
    )
    levels = cells.withColumn("split", F.explode(names))
    return kappa_and_f1(class_counts(levels, keys), keys).select(*keys, "n", "kappa")


def _numeric_cells(cells: DataFrame, keys: Sequence[str], label_order: Mapping[str, int] | None) -> DataFrame:
    if label_order is None:
        number = to_number
    else:
        ranks = F.create_map(*[F.lit(x) for kv in label_order.items() for x in (kv[0], float(kv[1]))])
        number = lambda name: F.coalesce(F.try_element_at(ranks, F.col(name)), F.lit(0.0))
    return (
        cells.select(*keys, number("label").alias("x"), number("prediction").alias("y"), "n")
        .groupBy(*keys, "x", "y")
        .agg(F.sum("n").alias("n"))
    )


def _spearman_of_cells(cells: DataFrame, keys: Sequence[str], label_order: Mapping[str, int] | None) -> DataFrame:
    """Spearman's rho from written cells."""
    return spearman_by_ranges(_numeric_cells(cells, keys, label_order), keys)


def _usable() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")


def _moments(ranked: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Exact sums of products of the centred ranks ``rx, ry`` with weight ``n``."""
    weight, rx, ry = exact("n"), exact("rx"), exact("ry")
    total = lambda product, name: F.sum((weight * product).cast("decimal(38,0)")).alias(name)
    return ranked.groupBy(*keys).agg(*more, total(rx * ry, "xy"), total(rx * rx, "xx"), total(ry * ry, "yy"))


def _rho() -> Column:
    """A group with a value that is no number, or with constant ranks, has rho 0.0."""
    rho = ratio(F.col("xy"), F.sqrt(F.col("xx").cast("double") * F.col("yy").cast("double")))
    return F.when(F.col("broken"), F.lit(0.0)).otherwise(F.coalesce(rho, F.lit(0.0))).alias("spearman")


def spearman_by_ranges(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman's rho from distinct number pairs ``x, y`` with weight ``n``, read from a written table.

    Twice the tie-averaged rank minus (N + 1) is an exact integer. Ranks come from the weighted distinct values of each side, through range partitions; the
    pairs look their two ranks up by joins, so no group is ever in one task.
    """
    broken = pairs.groupBy(*keys).agg(F.max(~_usable()).alias("broken"))
    numeric = pairs.where(_usable())
    sides = F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
    )
    values = (
        numeric.select(*keys, "n", F.explode(sides).alias("s"))
        .groupBy(*keys, "s.side", "s.value")
        .agg(F.sum("n").alias("weight"))
    )
    # Each side below reads its own ranges only: the side is part of the ranks' groups.
    ranks = average_ranks(values, [*keys, "side"], "value", "weight")
    for side in ("x", "y"):
        own = ranks.where(F.col("side") == side).select(
            *keys, F.col("value").alias(side), F.col("centred").alias(f"r{side}")
        )
        numeric = join_on(numeric, own, [*keys, side], null_safe=True)
    return join_on(broken, _moments(numeric, keys), keys, "left", null_safe=True).select(*keys, _rho())


def spearman(
    predictions: DataFrame,
    keys: Sequence[str] = KEYS,
    label_order: Mapping[str, int] | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Spearman's rho of labels and predictions read as numbers, or through an ordinal map.

    Labels outside the map count as 0.
    """
    found = _spearman_of_cells(settle(contingency(predictions, keys), "contingency"), keys, label_order)
    return _with_all_groups(found, groups, keys, ["spearman"])


def spearman_continuous(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's rho of two numeric columns with many distinct values.

    Values are ranked through range partitions, so no group is sorted in one task.
    """
    pairs = (
        df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .groupBy(*keys, "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return spearman_by_ranges(settle(pairs, "number-pairs"), keys)


def all_metrics(
    predictions: DataFrame,
    keys: Sequence[str] = KEYS,
    label_order: Mapping[str, int] | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Kappa, macro-F1 and rho per group from one pass over the predictions."""
    return metrics_of_cells(contingency(predictions, keys), keys, label_order, groups)


def metrics_of_cells(
    cells: DataFrame,
    keys: Sequence[str] = KEYS,
    label_order: Mapping[str, int] | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """All metrics from contingency cells. The cells are written once and read by each metric."""
    cells = settle(cells, "contingency")
    agreement = kappa_and_f1(class_counts(cells, keys), keys).select(*keys, "kappa", "f1")
    rho = _spearman_of_cells(cells, keys, label_order)
    return _with_all_groups(join_on(agreement, rho, keys, null_safe=True), groups, keys, ["kappa", "f1", "spearman"])


def metric_delta(old: Column | str, new: Column | str) -> Column:
    """Map of ``delta_<metric>`` over the metrics of either map; a missing metric counts as 0.0."""
    old, new = [F.col(c) if isinstance(c, str) else c for c in (old, new)]
    empty = F.create_map().cast("map<string,double>")
    zero = F.lit(0.0)
    deltas = F.map_zip_with(
        F.coalesce(old, empty), F.coalesce(new, empty),
        lambda _, a, b: F.coalesce(b, zero) - F.coalesce(a, zero),
    )
    return F.transform_keys(deltas, lambda k, _: F.concat(F.lit("delta_"), k))


def metrics_string(metrics: Column | str, precision: int = 3) -> Column:
    """The metrics of a map in its order and with that many decimals, such as ``κ=0.335 F1=0.412 ρ=0.287``."""
    metrics = F.col(metrics) if isinstance(metrics, str) else metrics
    symbols = F.create_map(*[F.lit(x) for kv in fixed.METRIC_SYMBOLS.items() for x in kv])
    parts = F.transform(
        F.map_entries(metrics),
        lambda e: F.concat(F.coalesce(F.try_element_at(symbols, e["key"]), e["key"]), F.lit("="), decimals(e["value"], precision)),
    )
    return F.array_join(parts, " ")


def metrics_map(suffix: str = "") -> Column:
    """The wide metric columns as one map."""
    return F.create_map(*[x for m in fixed.METRIC_SYMBOLS for x in (F.lit(m), F.col(f"{m}{suffix}"))])


def flat_metrics(metrics: str, suffix: str) -> list[Column]:
    """A metric map as wide columns; missing metrics are null."""
    return [F.try_element_at(F.col(metrics), F.lit(m)).alias(f"{m}{suffix}") for m in fixed.METRIC_SYMBOLS]


def metric_disagreement(deltas: DataFrame) -> DataFrame:
    """Flag rows whose ``delta_kappa``, ``delta_f1`` and ``delta_spearman`` differ in sign."""
    signs = [F.signum(or_zero(F.round(F.col(f"delta_{m}"), 12))) for m in fixed.METRIC_SYMBOLS]
    return deltas.withColumn("disagree", F.least(*signs) != F.greatest(*signs))
