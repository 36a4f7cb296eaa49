"""Mixing sources to target weights as a curriculum over training time.

Every source has a weight and a schedule, its relative weight over training time 0..1. ``targets`` shares all words
among the sources by weight; a target stops at ``MAX_REPEATS`` times the source's size and the excess is shared again.
The schedule is integrated to the source's cumulative demand for words. A source's documents stand in hash order, pass
after pass; a copy that begins at word x is trained at the time at which the demand reaches x, so the integral is
inverted, and documents are range-sorted by that time.

The last copy of a source can reach over its target: ``taken`` counts only its words below the target, and
``curriculum`` has that copy (whole) if at least half of it is below.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, the last one. Repeated rows are
documents of their own. Equal hashes fall back to doc_id. Only the named columns are read; others are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import identified, running_sum, word_count
from evalspark.plans.shared import settle

WEIGHTS = (5, 2, 1)
#: Relative weight at points of training time: heavy sources fade, light ones rise. Dealt like the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MAX_REPEATS = 3
#: Rows of a source that are sorted together, in expectation.
ROWS_IN_BLOCK = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, place, target`` from one row per source; the table of sources is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("_weight", weight)
    # Sources reach their caps in the order of cap / weight. With all earlier ones at their caps, "level" words per
    # unit of weight are left; the first source whose cap lies above its share of that sets the level for all others.
    filled = ranked.withColumn("_cap", repeats * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    by_ratio = Window.orderBy("_ratio", "place")
    before, onward, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    filled = filled.withColumn("_level", level).withColumn("_step", F.row_number().over(by_ratio))
    free = F.when(F.col("_ratio") > F.col("_level"), F.col("_step"))
    filled = filled.withColumn("_final", F.min_by("_level", free).over(every))
    share = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_final"))
    return filled.select("source", "source_size", "place", F.coalesce(share, F.col("_cap").cast("double")).alias("target"))


def time_of(share: Column, schedule) -> Column:
    """Training time at which the integral of a piecewise linear schedule reaches ``share`` of its whole (0..1)."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, done, out = math.fsum(areas), 0.0, None
    for (a, b), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        if not area:
            continue
        slope = (b[1] - a[1]) / (b[0] - a[0])
        left = F.greatest(share * whole - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a[1] * a[1]) + 2 * slope * left, F.lit(0.0)))
        time = F.when(left > 0, F.lit(a[0]) + 2 * left / (F.lit(a[1]) + root)).otherwise(F.lit(a[0]))
        done += area
        inside = share * whole < F.lit(done)
        out = F.when(inside, time) if out is None else out.when(inside, time)
    return out.otherwise(F.lit(float(schedule[-1][0])))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``.

    ``copies`` has (time, words) of each copy that is trained on, ``words`` being those below the target.
    """
    narrow = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "document-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes = settle(sizes, "source-sizes")
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    plan = settle(targets(sizes.drop("_rows"), weights, repeats), "source-targets")
    bits = max(10, math.ceil(math.log2(max(1, largest / ROWS_IN_BLOCK))))
    rows = narrow.withColumn("_key", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 1))
    rows = running_sum(rows, ["source"], ["_key", "doc_id", "size"], "size", "_begin", F.shiftright("_key", 63 - bits))
    plan = plan.withColumnRenamed("source", "_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("target") + 0.5).cast("long")
    copies = []
    for k in range(repeats):
        begin = F.col("source_size") * k + F.col("_begin")
        words = F.greatest(F.least(whole - begin, F.col("size")), F.lit(0)).cast("long")
        share = begin / whole
        time = None
        for n, schedule in enumerate(schedules):
            mine = F.col("place") % len(schedules) == n
            time = F.when(mine, time_of(share, schedule)) if time is None else time.when(mine, time_of(share, schedule))
        copies.append(F.when(words > 0, F.struct(time.alias("time"), words.alias("words"))))
    rows = rows.withColumn("copies", F.array_compact(F.array(*copies)))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def first_time() -> Column:
    return F.get("copies", F.lit(0))["time"]


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` once per trained copy, in order of training time; columns as in ``docs``.

    Each row has its own plan, also if its doc_id is null or repeats.
    """
    rows = identified(docs)
    mixed = mix(rows.select(F.col("row").alias("doc_id"), "d.source", "d.text"), weights, schedules, repeats)
    plan = mixed.select(F.col("doc_id").alias("of"), F.filter("copies", lambda c: 2 * c["words"] >= F.col("size")).alias("copies"))
    taken = rows.join(plan.filter(F.size("copies") > 0), F.col("row") == F.col("of")).select("row", "d", F.explode("copies.time").alias("time"))
    return taken.orderBy("time", "row").select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
