"""Order statistics that never sort a whole group in one task.

Four tools, all exact:

* ``running``: running sums, maxima, previous values and streaks in one scan. Rows are cut into
  ranges of equal numbers; a window works inside a range, and one row per group and range carries
  what came before.
* ``rank_cutoffs``: the keys at given ranks of a group ordered by a uniform hex key. A histogram
  over key prefixes finds the one prefix holding each cut, and is repeated on longer prefixes
  until few rows are left; only those are ranked.
* ``place``: row numbers over a whole table, through range partitions.
* ``average_ranks``: tie-averaged ranks of weighted distinct values. Values are range-partitioned
  over the cluster; a window works inside a range and range totals are carried forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.keys import join_on
from evalspark.plans.shared import settle

# Rows of one prefix that are ranked together.
CUT_ROWS = 100_000


def running(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    *,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    maxima_before: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    streaks: dict[str, tuple[Column, Callable[[Column, Column], Column]]] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add running columns over the rows of each group in the order of a position, in one scan.

    ``sums`` and ``maxima`` include the current row, ``maxima_before`` stops at the row before it,
    ``previous`` is the value of the row before. ``streaks`` names a value and a condition on (the
    value before, the value): the number of rows in a row, up to the current one, that meet it; the
    first row of a group never does. Positions must be unique in a group, and can be of any type
    that sorts.

    The rows are cut into ranges of about equal numbers. A window works inside each range; each group
    has one carry row per range it touches, so there are no more carry rows than ranges and groups
    together, however sparse the positions are.
    """
    sums, maxima, streaks = sums or {}, maxima or {}, streaks or {}
    maxima_before, previous = maxima_before or {}, previous or {}
    order = [F.col(c) for c in (*by, position)]
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    # Written, so that both uses of it see the same ranges.
    base = settle(dealt.withColumn("_range", F.spark_partition_id()), "scan-ranges")
    ordered = Window.partitionBy(*by, "_range").orderBy(position)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    # A null value differs from "there is no row before", so values are kept in structs.
    lagged = {n: F.lag(F.struct(v.alias("v"))).over(ordered) for n, v in {**previous, **{n: v for n, (v, _) in streaks.items()}}.items()}
    number = F.row_number().over(ordered)
    inner = base.select(
        "*",
        number.alias("_row"),
        *[F.sum(v).over(so_far).alias(f"_i_{n}") for n, v in sums.items()],
        *[F.max(v).over(so_far).alias(f"_i_{n}") for n, v in maxima.items()],
        *[F.max(v).over(before).alias(f"_i_{n}") for n, v in maxima_before.items()],
        *[lag.alias(f"_l_{n}") for n, lag in lagged.items()],
    )
    met = lambda n, past: F.coalesce(streaks[n][1](past, streaks[n][0]), F.lit(False))
    for name in streaks:
        # The last row of the range that ends a streak; whether its first row does depends on the range before.
        broken = (F.col("_row") > 1) & ~met(name, F.col(f"_l_{name}")["v"])
        inner = inner.withColumn(f"_b_{name}", F.max(F.when(broken, F.col("_row"))).over(so_far))
    joined = join_on(inner, _carries(inner, by, position, sums, {**maxima, **maxima_before}, previous, streaks, met), [*by, "_range"], "left")
    both = {
        **{n: F.col(f"_i_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums},
        **{n: F.greatest(f"_i_{n}", f"_c_{n}") for n in {**maxima, **maxima_before}},
        **{n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))["v"] for n in previous},
        **{n: F.col("_row") + F.col("_before") - F.coalesce(F.col("_before") + F.col(f"_b_{n}"), F.col(f"_c_{n}")) for n in streaks},
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in both.items()])


def _carries(inner, by, position, sums, maxima, previous, streaks, met) -> DataFrame:
    """What every range of a group gets from the ranges before it; for streaks, the row at which the last one ended,
    counted through the group."""
    last, first = (lambda v, f=f: f(F.struct(v.alias("v")), F.col(position)) for f in (F.max_by, F.min_by))
    totals = inner.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"_t_{n}") for n, v in maxima.items()],
        *[last(v).alias(f"_t_{n}") for n, v in previous.items()],
        *[last(v).alias(f"_t_{n}") for n, (v, _) in streaks.items()],
        *[first(v).alias(f"_f_{n}") for n, (v, _) in streaks.items()],
        *[F.max(f"_b_{n}").alias(f"_b_{n}") for n in streaks],
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    out = totals.select(
        "*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
        *[F.last(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in previous],
        *[F.last(f"_t_{n}").over(earlier).alias(f"_p_{n}") for n in streaks],
    )
    for n, (value, condition) in streaks.items():
        goes_on = F.col(f"_p_{n}").isNotNull() & F.coalesce(condition(F.col(f"_p_{n}")["v"], F.col(f"_f_{n}")["v"]), F.lit(False))
        start = F.when(~goes_on, F.col("_before") + 1)
        out = out.withColumn(f"_e_{n}", F.greatest(F.col("_before") + F.col(f"_b_{n}"), start)).withColumn(f"_s_{n}", start)
    return out.select(
        *by, "_range", "_before", *[f"_c_{n}" for n in (*sums, *maxima, *previous)],
        *[F.greatest(F.max(f"_e_{n}").over(earlier), F.col(f"_s_{n}")).alias(f"_c_{n}") for n in streaks],
    )


def prefix_histogram(df: DataFrame, by: Sequence[str], key: str, digits: int = 3) -> DataFrame:
    """Rows per group and key prefix, ``16**digits`` prefixes per group, as a written table."""
    counts = df.groupBy(*by, F.substring(key, 1, digits).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    return settle(counts, "prefix-histogram")


def rank_cutoffs(
    df: DataFrame, by: Sequence[str], key: str, cuts: DataFrame, histogram: DataFrame, digits: int = 3, rows: int = CUT_ROWS
) -> DataFrame:
    """The key standing at each cut's rank (``by``, ``cut``, ``key``).

    ``cuts`` has ``by``, ``cut`` (a name) and ``rank`` (1-based, at most the group's size). Keys
    must be unique in a group and of one length. While the prefix that holds a cut has more than
    ``rows`` rows, a histogram of its next digits narrows it; each round is one narrow pass over
    ``df`` in which only counts are shuffled. In the end the few rows left for each cut are ranked.
    """
    wanted = cuts.withColumnRenamed("rank", "_rank").withColumn("_whole", F.lit(""))
    steps, length = histogram.withColumn("_whole", F.lit("")), digits
    while True:
        inside = [*by, "_whole"]
        ordered = Window.partitionBy(*inside).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        ranked = steps.withColumn("_before", F.coalesce(F.sum("_n").over(ordered), F.lit(0)))
        here = (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))
        holding = settle(
            join_on(ranked, wanted, inside, null_safe=True).where(here)
            .select(*by, "_prefix", "cut", (F.col("_rank") - F.col("_before")).alias("_offset"), "_n"),
            "cut-prefixes",
        )
        near = lambda: join_on(
            df.select(*by, key, F.substring(key, 1, length).alias("_prefix")),  # noqa: B023
            holding.select(*by, "_prefix").distinct(), [*by, "_prefix"], null_safe=True,  # noqa: B023
        )
        if (holding.agg(F.max("_n")).first()[0] or 0) <= rows:
            break
        deeper = near().withColumn("_whole", F.col("_prefix")).withColumn("_prefix", F.substring(key, 1, length + digits))
        steps = settle(deeper.groupBy(*by, "_whole", "_prefix").agg(F.count(F.lit(1)).alias("_n")), "prefix-histogram")
        wanted = holding.select(*by, "cut", F.col("_prefix").alias("_whole"), F.col("_offset").alias("_rank"))
        length += digits
    found = join_on(near(), holding.select(*by, "_prefix", "cut", "_offset"), [*by, "_prefix"], null_safe=True)
    place = Window.partitionBy(*by, "_prefix", "cut").orderBy(key)
    return (
        found.withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") == F.col("_offset"))
        .select(*by, "cut", F.col(key).alias("key"))
    )


def place(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows in a total order. Rows are range-partitioned; range sizes are carried forward."""
    ranged = settle(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "placed-ranges"
    )
    # One row per range, so this window is as small as the number of partitions.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return join_on(ranged.withColumn("_inside", inside), carry, ["_range"]).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(name)
    )


def average_ranks(values: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Add ``centred``: twice the tie-averaged rank minus (N + 1), an exact integer with mean 0.

    ``values`` has one row per group and distinct value with its weight, so a value that most
    rows share is one row here.
    """
    values = values.select(*by, value, weight)
    ranged = settle(
        values.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "value-ranges"
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and range it touches.
    carry = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum(weight).alias("_w"))
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_below"),
            F.sum("_w").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = join_on(placed, carry, [*by, "_range"], null_safe=True)
    return joined.select(
        *by, value, weight,
        (2 * (F.col("_below") + F.col("_inside")) + F.col(weight) - F.col("_total")).alias("centred"),
    )
