"""Lineage graphs against plain graph walks."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import dag as G


def plain(nodes, edges):
    """{node: (roots with least depths, greatest depth, cyclic)} of one run."""
    parents = {n: {p for c, p in edges if c == n} for n in nodes}
    children = {n: {c for c, p in edges if p == n} for n in nodes}
    least = {n: {} for n in nodes}
    for root in (n for n in nodes if not parents[n]):
        front, depth = {root}, 0
        while front:
            for n in front:
                least[n][root] = depth
            front, depth = {c for n in front for c in children[n] if root not in least[c]}, depth + 1
    greatest, changed = {}, True
    while changed:
        changed = False
        for n in nodes:
            if n not in greatest and all(p in greatest for p in parents[n]):
                greatest[n], changed = max((greatest[p] + 1 for p in parents[n]), default=0), True
    return {n: (least[n], greatest.get(n), n not in greatest) for n in nodes}


def graphs():
    rng = random.Random(4)
    out = {"empty parents": (range(1, 6), [])}
    out["chain with merges"] = (range(1, 60), [(i, i - 1) for i in range(2, 60)] + [(i, i // 2) for i in range(10, 60, 7)])
    out["diamonds"] = (range(1, 61), [(i, i - d) for i in range(4, 61, 3) for d in (2, 3)] + [(i + k, i) for i in range(1, 61, 3) for k in (1, 2) if i + k < 61])
    for seed in range(4):
        n = 40
        out[f"forward {seed}"] = (range(1, n), [(i, rng.randrange(1, i)) for i in range(2, n) for _ in range(rng.choice([0, 1, 1, 1, 2, 4]))])
        out[f"any {seed}"] = (range(1, n), [(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(n)])
    out["own parent"] = ([1, 2, 3, 4], [(1, 1), (2, 1), (2, 3), (4, 2)])
    out["cycle of single parents"] = ([1, 2, 3, 4, 5, 6], [(2, 3), (3, 2), (4, 3), (5, 4), (5, 1), (6, 5)])
    return out


def test_equals_plain_walks(spark):
    made = graphs()
    nodes = spark.createDataFrame([(r, n) for r, (ns, _) in made.items() for n in ns], "run_id string, iter bigint")
    edges = spark.createDataFrame([(r, c, p) for r, (_, es) in made.items() for c, p in set(es)], "run_id string, iter bigint, parent bigint")
    want = {r: plain(list(ns), set(es)) for r, (ns, es) in made.items()}
    found = {(r.run_id, r.iter): (r.roots, r.least_depth, r.greatest_depth, r.cyclic) for r in G.lineage_dag(nodes, edges).collect()}
    assert found == {
        (run, n): (len(least), min(least.values(), default=None), greatest, cyclic) for run, rows in want.items() for n, (least, greatest, cyclic) in rows.items()
    }
    roots = {(r.run_id, r.iter, r.root_iter): r.depth for r in G.lineage_roots(nodes, edges).collect()}
    assert roots == {(run, n, root): depth for run, rows in want.items() for n, (least, _, _) in rows.items() for root, depth in least.items()}


def test_edges_from_parents_and_merges(spark):
    log = spark.createDataFrame([("r", 1, 1, None), ("r", 2, 1, 1), ("r", 3, 2, 2), ("r", 4, 2, 77), ("s", 1, 1, None)], "run_id string, iter bigint, batch bigint, parent bigint")
    merges = spark.createDataFrame([("r", 2, [1, 2, 1, 99]), ("r", 9, [1]), ("s", 1, [])], "run_id string, batch bigint, iters array<bigint>")
    assert {tuple(r) for r in G.lineage_edges(log, merges).collect()} == {("r", 2, 1), ("r", 3, 1), ("r", 3, 2), ("r", 4, 1), ("r", 4, 2)}
    assert G.lineage_edges(log, merges).count() == 5
    empty = log.where("iter < 0")
    assert G.lineage_dag(empty, G.lineage_edges(empty)).count() == 0


def test_rounds_count_merges_and_not_entries(spark, monkeypatch):
    """Two chains of 150 entries that meet once: one round finds the roots behind the merge."""
    names = []
    settle = G.settle
    monkeypatch.setattr(G, "settle", lambda df, name: names.append(name) or settle(df, name))
    edges = [(i, i - 1) for i in [*range(2, 151), *range(202, 351)]] + [(400, 150), (400, 350), *[(i, i - 1) for i in range(401, 500)]]
    ids = [*range(1, 151), *range(201, 351), *range(400, 500)]
    nodes = spark.createDataFrame([("r", i) for i in ids], "run_id string, iter bigint")
    found = G.lineage_dag(nodes, spark.createDataFrame([("r", *e) for e in edges], "run_id string, iter bigint, parent bigint"))
    last = found.where("iter = 499").first()
    assert (last.roots, last.least_depth, last.greatest_depth, last.cyclic) == (2, 249, 249, False)
    assert names.count("dag-delta") == 2  # the second one is empty


@pytest.mark.parametrize("children", [100_000])
def test_a_hub_with_many_children(spark, children):
    """All children name the hub and one other entry: each is a merge, and their joins with the hub's one row are dealt out."""
    nodes = spark.range(1, children + 3).select(F.lit("r").alias("run_id"), F.col("id").alias("iter"))
    more = nodes.where("iter > 2").select("run_id", "iter", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("parent"))
    found = G.lineage_dag(nodes, more)
    assert found.groupBy("roots", "least_depth", "greatest_depth", "cyclic").count().orderBy("roots").collect() == [(1, 0, 0, False, 2), (2, 1, 1, False, children)]
    joined = G._roots(*(lambda places, arcs: (places, G._reach(G._starts(places, arcs), arcs)))(*G._contract(nodes, more)))
    assert joined.count() == 2 + 2 * children
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
