"""Connected components of a table of links, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.shared import settle


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link (columns ``a`` and ``b``); a component is its smallest node.

    Each round every node points to its neighbour of least rank, or stays if its own is less; links between the targets
    are the links of the next round. Rank is the id at first, which ends groups around a hub at once, then a new hash
    each round, under which long chains shrink by a constant factor whatever their order. Rounds are written tables.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(links.filter(F.col("a") != F.col("b")).select(least.alias("a"), most.alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(steps)
        rank = (lambda c: F.xxhash64(c, F.lit(turn))) if turn > 1 else (lambda c: F.col(c))  # noqa: B023
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("rank"), "v")).alias("best"))
        own = F.struct(rank("u").alias("rank"), F.col("u").alias("v"))
        step = settle(best.select("u", F.least("best", own)["v"].alias("target")), "component-step")
        steps.append(step)
        moved = edges.join(step.select(F.col("u").alias("a"), F.col("target").alias("ta")), "a")
        moved = moved.join(step.select(F.col("u").alias("b"), F.col("target").alias("tb")), "b").filter(F.col("ta") != F.col("tb"))
        edges = settle(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("u").alias("_t"), F.col("target").alias("_root"))
        roots = step.join(later, F.col("target") == F.col("_t"), "left").select("u", F.coalesce("_root", "target").alias("target"))
    if len(steps) <= 2:
        return roots.select(F.col("u").alias("node"), F.col("target").alias("component"))
    roots = settle(roots, "component-roots")
    smallest = settle(roots.groupBy("target").agg(F.min("u").alias("component")), "component-names")
    return roots.join(smallest, "target").select(F.col("u").alias("node"), "component")
