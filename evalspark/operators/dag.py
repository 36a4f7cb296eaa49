"""Lineage as a graph: an entry can have several parents, its own and those its batch was merged from.

Reachability is evaluated semi-naively: a round joins only the facts that the round before found (the delta) with the
edges, and an anti-join with all known facts leaves those that are new or shorter. Runs of entries with a single parent
are contracted first, by the pointer doubling of ``log.lineage``, so the rounds count the merges on a path, not its
entries. The longest depth is found by peeling: an entry is settled in the round in which its last parent is, and each
edge is used once; what is never settled lies on a cycle or behind one.

Every round is a written table. Joins are on (run, entry); a hub with many children is one row on the other side, so
Catalyst broadcasts it or splits the children's partition.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.keys import join_on
from evalspark.operators.log import ENTRY, lineage
from evalspark.plans.shared import settle

ROUNDS_IN_PLAN = 8


def lineage_edges(log: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """``run_id, iter, parent``: the parent of every entry, and the entries that its batch was merged from.

    ``merges`` has ``run_id, batch, iters``. Parents that are not in the log drop out; an edge stands once.
    """
    edges = log.where(F.col("parent").isNotNull()).select(*ENTRY, "parent")
    if merges is not None:
        named = merges.select("run_id", "batch", F.explode("iters").alias("parent"))
        edges = edges.unionByName(join_on(log.select(*ENTRY, "batch"), named, ["run_id", "batch"]).select(*ENTRY, "parent"))
    present = log.select("run_id", F.col("iter").alias("parent"))
    return join_on(edges.distinct(), present, ["run_id", "parent"], "left_semi").select(*ENTRY, "parent")


def _contract(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nearest root or merge above every entry, and the arcs between those.

    ``places``: ``run_id, iter, anchor, depth`` (steps up to the anchor; both null on or behind a cycle of single
    parents). ``arcs``: ``run_id, iter, anchor, near, far`` from a merge to an anchor above it, with the least and the
    greatest number of steps. An anchor of null stands for a parent that has none.
    """
    degrees = edges.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("_parents"), F.min("parent").alias("_only"))
    known = settle(join_on(nodes, degrees, ENTRY, "left").withColumn("_parents", F.coalesce("_parents", F.lit(0))), "dag-degrees")
    chains = lineage(known.select(*ENTRY, F.when(F.col("_parents") == 1, F.col("_only")).alias("parent")))
    places = settle(chains.select(*ENTRY, F.col("root_iter").alias("anchor"), "depth"), "dag-places")
    merged = join_on(edges, known.where(F.col("_parents") > 1).select(*ENTRY), ENTRY, "left_semi")
    above = places.select("run_id", F.col("iter").alias("parent"), "anchor", "depth")
    step = F.col("depth") + 1
    arcs = join_on(merged, above, ["run_id", "parent"]).groupBy(*ENTRY, "anchor").agg(F.min(step).alias("near"), F.max(step).alias("far"))
    return places, settle(arcs, "dag-arcs")


def _compact(facts: DataFrame, turn: int) -> DataFrame:
    """One table in place of the last rounds' tables, now and then, so that plans stay short."""
    return settle(facts, "dag-facts") if turn % ROUNDS_IN_PLAN == 0 else facts


def _reach(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """``run_id, iter, root_iter, depth``: all roots above every anchor, with the least number of steps."""
    fact = (*ENTRY, "root_iter")
    known = delta = settle(starts.select(*ENTRY, F.col("iter").alias("root_iter"), F.lit(0).cast("bigint").alias("depth")), "dag-facts")
    up = arcs.where(F.col("anchor").isNotNull()).select("run_id", F.col("iter").alias("_to"), F.col("anchor").alias("iter"), "near")
    for turn in count(1):
        further = join_on(delta, up, ENTRY).select("run_id", F.col("_to").alias("iter"), "root_iter", (F.col("depth") + F.col("near")).alias("depth"))
        further = further.groupBy(*fact).agg(F.min("depth").alias("depth"))
        old = known.select(*fact, F.col("depth").alias("_known"))
        same = [further[c] == old[c] for c in fact]
        delta = settle(further.join(old, [*same, further["depth"] >= old["_known"]], "left_anti"), "dag-delta")
        if delta.isEmpty():
            return known.groupBy(*fact).agg(F.min("depth").alias("depth"))
        known = _compact(known.unionByName(delta), turn)


def _peel(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """``run_id, iter, far``: the greatest number of steps from a root, for anchors with no cycle above them."""
    needed = settle(arcs.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("_needed")), "dag-needed")
    done = delta = settle(starts.select(*ENTRY, F.lit(0).cast("bigint").alias("far")), "dag-peeled")
    waiting: DataFrame | None = None
    down = arcs.select("run_id", F.col("iter").alias("_to"), F.col("anchor").alias("iter"), F.col("far").alias("_step"))
    for turn in count(1):
        met = join_on(delta, down, ENTRY).groupBy("run_id", F.col("_to").alias("iter")).agg(
            F.count(F.lit(1)).alias("_met"), F.max(F.col("far") + F.col("_step")).alias("far")
        )
        if waiting is not None:
            met = met.unionByName(waiting).groupBy(*ENTRY).agg(F.sum("_met").alias("_met"), F.max("far").alias("far"))
        state = settle(join_on(met, needed, ENTRY), "dag-waiting")
        delta = state.where(F.col("_met") == F.col("_needed")).select(*ENTRY, "far")
        if delta.isEmpty():
            return done
        waiting = state.where(F.col("_met") < F.col("_needed")).select(*ENTRY, "_met", "far")
        done = _compact(done.unionByName(delta), turn)


def lineage_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, iter, root_iter, depth``: every root above an entry and the least number of steps to it.

    ``nodes`` has ``run_id, iter``; ``edges`` as from ``lineage_edges``. A root is its own, at depth 0. Entries on or
    behind a cycle have the roots that some path leads to, or none.
    """
    places, arcs = _contract(nodes.select(*ENTRY), edges)
    return _roots(places, _reach(_starts(places, arcs), arcs))


def _starts(places: DataFrame, arcs: DataFrame) -> DataFrame:
    """Anchors without parents."""
    return join_on(places.where(F.col("iter") == F.col("anchor")), arcs.select(*ENTRY).distinct(), ENTRY, "left_anti")


def _roots(places: DataFrame, reached: DataFrame) -> DataFrame:
    above = reached.select("run_id", F.col("iter").alias("anchor"), "root_iter", F.col("depth").alias("_above"))
    return join_on(places, above, ["run_id", "anchor"]).select(*ENTRY, "root_iter", (F.col("depth") + F.col("_above")).alias("depth"))


def lineage_dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, iter, roots, least_depth, greatest_depth, cyclic`` of every entry.

    ``roots`` counts the roots above an entry (itself, if it has no parent). Depths are the steps of the shortest and the
    longest path from a root. ``cyclic`` marks entries on a cycle or behind one: they have no greatest depth, and no
    least one if no root leads to them.
    """
    places, arcs = _contract(nodes.select(*ENTRY), edges)
    starts = settle(_starts(places, arcs), "dag-starts")
    reached = settle(_reach(starts, arcs), "dag-reached")
    least = reached.groupBy("run_id", F.col("iter").alias("anchor")).agg(F.count(F.lit(1)).alias("roots"), F.min("depth").alias("_least"))
    greatest = _peel(starts, arcs).select("run_id", F.col("iter").alias("anchor"), F.col("far").alias("_greatest"))
    above = settle(join_on(least, greatest, ["run_id", "anchor"], "left"), "dag-anchors")
    return join_on(places, above, ["run_id", "anchor"], "left").select(
        *ENTRY, F.coalesce("roots", F.lit(0)).alias("roots"), (F.col("depth") + F.col("_least")).alias("least_depth"),
        (F.col("depth") + F.col("_greatest")).alias("greatest_depth"), F.col("_greatest").isNull().alias("cyclic"),
    )
