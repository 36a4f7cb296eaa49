import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import artifacts as A
from evalspark.operators import log as L
from evalspark.operators import ranking as R

COLUMNS = (
    "run_id string, iter bigint, batch bigint, parent bigint, plan_id string, kappa_train double, kappa_dev double, kappa_test double, "
    "f1_dev double, spearman_dev double, rationale string, artifact string, artifact_hash string, stage_a_summary string"
)


def make(spark, entries):
    """Entries as (iter, batch, parent, plan, dev, test)."""
    data = [("r", i, b, p, plan, 0.3, d, t, d, d, f"because {i} " * 20, f"text {i}", f"h{i}", None) for i, b, p, plan, d, t in entries]
    return spark.createDataFrame(data, COLUMNS)


SMALL = [(1, 1, None, "first", 0.5, 0.375), (2, 1, 1, "shorter", 0.25, 0.125)]


def test_small_log(spark):
    log = make(spark, SMALL)
    assert L.best_entry(log).first().iter == 1
    assert L.entries_by_batch(log, 1).count() == 2 and L.entry_by_iter(log, 2).first().plan_id == "shorter"
    stats = {r.plan_id: r for r in L.plan_statistics(log).collect()}
    assert (stats["first"].proposed, stats["first"].won, stats["first"].mean_delta_dev) == (1, 1, 0.0)
    assert (stats["shorter"].won, stats["shorter"].mean_delta_dev) == (0, pytest.approx(-0.25))
    assert [r.gap for r in L.gap_trend(log).collect()] == [pytest.approx(0.125)] * 2
    runs = spark.createDataFrame([("r",), ("new",)], "run_id string")
    assert {tuple(r) for r in L.log_position(log, runs).collect()} == {("r", 2, 1), ("new", 0, 0)}


def test_better_plan_wins(spark):
    log = make(spark, [SMALL[0], (2, 1, 1, "longer", 0.75, 0.5)])
    assert L.best_callout(log).first().iter == 2
    table = L.plan_table(log).collect()
    assert [(r.plan_id, r.won, r.win_rate) for r in table] == [("longer", 1, 100.0), ("first", 0, 0.0)]
    assert table[0].mean_delta_dev == pytest.approx(0.25)


def test_ties_missing_kappa_and_siblings_of_one_plan(spark):
    log = make(spark, [
        (1, 1, None, "a", None, 0.1), (2, 1, None, "b", 0.2, 0.1), (3, 1, None, "c", 0.2, 0.1),
        (4, 2, 2, "s", 0.3, 0.1), (5, 2, 99, "s", 0.1, 0.1), (6, 2, None, "n", float("nan"), 0.1),
    ])
    assert {(r.batch, r.iter) for r in L.batch_winners(log).collect()} == {(1, 2), (2, 4)}
    stats = {r.plan_id: r for r in L.plan_statistics(log).collect()}
    assert (stats["s"].proposed, stats["s"].won, stats["s"].won_entries) == (2, 2, 1)
    # The parent 99 is not in the log, so only one delta counts.
    assert stats["s"].mean_delta_dev == pytest.approx(0.1)
    assert L.best_entry(log).first().iter == 4
    empty = log.where("iter < 0")
    for operator in (L.best_entry, L.plan_statistics, L.batch_best, L.run_summary, L.gap_growth, L.lineage, L.run_comparison):
        assert operator(empty).count() == 0


def test_leak_guard(spark):
    view = A.selector_view(make(spark, SMALL))
    assert not [c for c in view.columns if "test" in c] and "kappa_dev" in view.columns
    lines = L.history_lines(L.history_view(A.selector_view(make(spark, SMALL)))).collect()
    assert all("test" not in r.line.replace("test_plan", "") for r in lines)


def test_history(spark):
    log = make(spark, [(i, 1, None, "p", 0.9 if i == 1 else 0.1, 0.1) for i in range(1, 13)])
    parents = spark.createDataFrame([("r", 3)], "run_id string, iter bigint")
    view = L.history_view(log, full_count=5, parents=parents)
    assert sorted(r.iter for r in view.where("full").collect()) == [1, 3, 8, 9, 10, 11, 12]
    text = {r.iter: r.line for r in L.history_lines(view).collect()}
    assert text[2] == "iter=2 batch=1 parent=None plan=p train-κ=0.300 dev-κ=0.100 rationale=" + ("because 2 " * 20)[:100] + "..."
    assert text[1].startswith("--- iter=1 batch=1 parent=None plan=p ---\nRationale: because 1")
    assert text[1].endswith("\nArtifact:\n<PROMPT>\ntext 1\n</PROMPT>")
    detail = L.batch_details(log).first()
    assert detail.rationale == ("because 1 " * 20)[:50] + "..."


def forest(seed, n):
    rng = random.Random(seed)
    return {i: (None if i == 1 or rng.random() < 0.1 else rng.randrange(1, i)) for i in range(1, n + 1)}


@pytest.mark.parametrize("parents", [{i: i - 1 or None for i in range(1, 301)}, forest(1, 60)], ids=["chain", "forest"])
def test_lineage(spark, parents):
    log = make(spark, [(i, 1, p, "p", 0.1, 0.1) for i, p in parents.items()] + [(999, 1, 5000, "p", 0.1, 0.1)])
    found = {r.iter: (r.root_iter, r.depth) for r in L.lineage(log).collect()}
    assert len(found) == len(parents) + 1 and found[999] == (999, 0)
    targets = [max(parents), len(parents) // 2]
    chains = {(r.target_iter, r.iter): r.distance for r in L.ancestors(log, log.where(F.col("iter").isin(targets))).collect()}
    want = {}
    for i in parents:
        at, depth = i, 0
        while True:
            if i in targets:
                want[i, at] = depth
            if parents[at] is None:
                break
            at, depth = parents[at], depth + 1
        assert found[i] == (at, depth)
    assert chains == want


def test_running_values_across_ranges(spark):
    rng = random.Random(3)
    data = [(g, i, rng.choice([None, rng.random()])) for g in "ab" for i in rng.sample(range(1, 200), 80)]
    df = spark.createDataFrame(data, "g string, i bigint, v double").repartition(5)
    found = R.running(
        df, ["g"], "i", ranges=9, sums={"n": F.lit(1)}, maxima={"top": F.col("v")}, maxima_before={"was": F.col("v")}, previous={"prev": F.col("v")},
        streaks={"up": (F.col("v"), lambda before, now: now > before)},
    ).toPandas().sort_values(["g", "i"])
    want = pd.DataFrame(data, columns=["g", "i", "v"]).sort_values(["g", "i"])
    want["n"] = want.groupby("g").cumcount() + 1
    want["top"] = want.groupby("g").v.transform(lambda s: s.cummax().ffill())
    want["was"] = want.groupby("g").top.shift()
    want["prev"] = want.groupby("g").v.shift()
    rises = want.v > want.prev
    want["up"] = rises.groupby([want.g, (~rises).cumsum()]).cumsum().astype(int)
    pd.testing.assert_frame_equal(found.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_streaks_over_ranges_that_end_nowhere_or_everywhere(spark, ranges):
    """Streaks that fill ranges, end at their borders, and belong to groups of one row."""
    rng = random.Random(ranges)
    values = {"up": list(range(60)), "down": list(range(60, 0, -1)), "flat": [1] * 20, "one": [5], "saw": [k % 7 for k in range(50)], "any": [rng.random() for _ in range(80)]}
    rows = [(g, 1000 * k, float(v)) for g, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i bigint, v double")
    found = R.running(df, ["g"], "i", ranges=ranges, streaks={"up": (F.col("v"), lambda before, now: now > before)}, sums={"n": F.lit(1)})
    want = {}
    for g, vs in values.items():
        streak = 0
        for k, v in enumerate(vs):
            streak = streak + 1 if k and v > vs[k - 1] else 0
            want[g, 1000 * k] = (streak, k + 1)
    assert {(r.g, r.i): (r.up, r.n) for r in found.collect()} == want


def test_sparse_positions_make_no_more_carry_rows_than_ranges(spark, monkeypatch):
    """Positions that step by 10 million: blocks of positions would have held one row each."""
    seen = []
    carries = R._carries
    monkeypatch.setattr(R, "_carries", lambda *a: seen.append(carries(*a)) or seen[-1])
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 10_000_000).alias("i"))
    found = R.running(df, ["g"], "i", ranges=8, sums={"n": F.lit(1)})
    assert found.agg(F.max("n")).first()[0] == 1667 and found.where("n <> i div 30000000 + 1").count() == 0
    assert seen[0].count() <= 8 + 3


def test_gap_growth_and_running_best(spark):
    gaps = [0.01, 0.02, 0.05, 0.08, 0.02, 0.03]
    log = make(spark, [(i, 1, i - 1 or None, "p", 0.2 + g, 0.2) for i, g in enumerate(gaps, 1)])
    growth = {r.iter: (r.streak, r.alarm) for r in L.gap_growth(log).collect()}
    assert growth == {1: (0, False), 2: (1, False), 3: (2, False), 4: (3, True), 5: (0, False), 6: (1, False)}
    bands = {r.iter: r.band for r in L.gap_bands(log).collect()}
    assert bands[1] == "healthy" and bands[3] == "caution" and bands[4] == "caution"
    best = {r.iter: (r.best_so_far, r.gain) for r in L.running_best(log).collect()}
    assert best[4] == (pytest.approx(0.28), pytest.approx(0.03)) and best[5] == (pytest.approx(0.28), 0.0) and best[1][1] == 0.0
    rates = {r.iter: (r.wins, r.judged, r.alarm) for r in L.win_rate(log).collect()}
    assert rates[5] == (3, 4, False)
    assert L.log_as_of(log, 3).count() == 3


def test_numbering_and_entries(spark):
    log = make(spark, SMALL)
    new = spark.createDataFrame([("r", 10, "x"), ("r", 4, "y"), ("other", 5, "z")], "run_id string, at bigint, plan_id string")
    numbered = {r.plan_id: (r.iter, r.batch) for r in L.number_candidates(new, log, "at").collect()}
    assert numbered == {"y": (3, 2), "x": (4, 2), "z": (1, 1)}
    results = spark.createDataFrame(
        [("r", h, s, 0.5, 0.5, 0.0) for h, splits in (("h1", ["train", "dev", "test"]), ("h2", ["train", "dev"])) for s in splits],
        "run_id string, artifact_hash string, split string, kappa double, f1 double, spearman double",
    )
    # h1 and its sibling share a plan; h2 is incomplete.
    rows = spark.createDataFrame([("r", "h1", "p"), ("r", "h2", "p")], "run_id string, artifact_hash string, plan_id string")
    assert [r.artifact_hash for r in L.build_entries(results, rows).collect()] == ["h1"]


def test_merge_parents_and_dedupe(spark):
    log = make(spark, SMALL)
    chosen = spark.createDataFrame([("r", 1, [2, 1, 7]), ("r", 2, [])], "run_id string, selection_id bigint, iters array<bigint>")
    assert {(r.iter, r.base_iter) for r in L.merge_parents(chosen, log).collect()} == {(1, 7), (2, 7)}
    twice = log.unionByName(log.withColumn("iter", F.col("iter") + 10))
    assert sorted(r.iter for r in A.dedupe_artifacts(twice).collect()) == [1, 2]


def test_places(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 37)
    places = R.place(df, [F.desc("v"), F.asc("id")], "place").orderBy("place").collect()
    assert [r.id for r in places] == sorted(range(500), key=lambda i: (-(i % 37), i)) and places[-1].place == 500


def test_cycles_of_parents_end(spark):
    log = make(spark, [(1, 1, None, "a", 0.1, 0.1), (2, 1, 3, "a", 0.1, 0.1), (3, 1, 2, "a", 0.1, 0.1), (4, 1, 3, "a", 0.1, 0.1), (5, 1, 5, "a", 0.1, 0.1), (6, 1, 1, "a", 0.1, 0.1)])
    found = {r.iter: (r.root_iter, r.depth, r.cyclic) for r in L.lineage(log).collect()}
    none = (None, None, True)
    assert found == {1: (1, 0, False), 2: none, 3: none, 4: none, 5: none, 6: (1, 1, False)}
    targets = spark.createDataFrame([("r", 4), ("r", 6)], "run_id string, iter bigint")
    chain = {(r.target_iter, r.iter): r.distance for r in L.ancestors(log, targets).collect()}
    assert chain == {(4, 4): 0, (4, 3): 1, (4, 2): 2, (6, 6): 0, (6, 1): 1}


def test_ties_leave_one_artifact(spark):
    rows = spark.createDataFrame([("r", 1, "x", "b"), ("r", 1, "x", "a"), ("r", 2, "x", "c")], "run_id string, iter bigint, artifact_hash string, note string")
    assert [tuple(r) for r in A.dedupe_artifacts(rows).collect()] == [("r", 1, "x", "a")]
