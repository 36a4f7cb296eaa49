"""Cells kept up to date by deltas against counting everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.plans.shared import new_folder
from evalspark.sources import cells as S


def frame(spark, rows):
    return spark.createDataFrame(rows, S.ROW)


@pytest.fixture(scope="module")
def appends():
    """Predictions in five appends; later ones replace some pairs, change labels, or say the same again."""
    rng = random.Random(8)
    pair = lambda: (rng.choice("pq"), f"a{rng.randrange(6)}", rng.choice(["dev", "test"]), rng.randrange(40))
    out = [[(*pair(), rng.choice("xy"), rng.choice(["x", "y", "", None])) for _ in range(n)] for n in (300, 1, 120, 60)]
    return [*out, out[0][:80]]


def counted(rows):
    newest = {}
    for part in rows:
        fresh = {}
        for *key, label, prediction in part:
            value = (label, prediction)
            old = fresh.get(tuple(key))
            least = lambda v: tuple((x is not None, x or "") for x in v)
            fresh[tuple(key)] = value if old is None or least(value) < least(old) else old
        newest.update(fresh)
    cells = {}
    for (run, name, split, _), (label, prediction) in newest.items():
        cells[run, name, split, label, prediction] = cells.get((run, name, split, label, prediction), 0) + 1
    return newest, cells


def test_cells_after_every_append_equal_a_recount(spark, appends):
    path = new_folder(spark, "cells")
    S.new_store(spark, path)
    read = lambda: {tuple(r)[:5]: r.n for r in S.current_cells(spark, path).collect()}
    assert read() == {} and S.compact(spark, path) == -1
    for number, part in enumerate(appends):
        change = S.append_predictions(frame(spark, part), path, number)
        newest, cells = counted(appends[: number + 1])
        assert read() == cells
        assert change.count() <= 2 * len({r[:4] for r in part})
        if number == 2:
            S.append_predictions(frame(spark, part), path, number)  # repeated after a failure
            assert read() == cells
            assert S.compact(spark, path) == 2 and read() == cells and S.compact(spark, path) == 2
            with pytest.raises(ValueError, match="generation"):
                S.append_predictions(frame(spark, part), path, 2)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in S.current_predictions(spark, path).collect()} == newest
    whole = M.metrics_of_cells(S.current_cells(spark, path)).orderBy(*M.KEYS).collect()
    assert whole == M.all_metrics(S.current_predictions(spark, path)).orderBy(*M.KEYS).collect()


def test_an_append_reads_only_the_slots_it_touches(spark):
    path = new_folder(spark, "cells")
    S.new_store(spark, path)
    many = spark.range(3000).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("a"), (F.col("id") % 100).cast("string")).alias("artifact_hash"), F.lit("dev").alias("split"), "id",
        F.lit("x").alias("label"), F.lit("y").alias("prediction"),
    )
    S.append_predictions(many, path, 0)
    small = many.where("artifact_hash = 'a7'").withColumn("prediction", F.lit("x"))
    change = S.append_predictions(small, path, 1)
    assert {(r.prediction, r.n) for r in change.collect()} == {("x", 30), ("y", -30)}
    slot = small.select(S._slot()).first()[0]
    old = S.replaced_rows(small, path, 1, [slot])
    assert old.count() == 30
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*slot#\d+ = {slot}\)", plan)


def test_tasks_do_not_grow_with_an_append(spark, monkeypatch):
    path = new_folder(spark, "cells")
    S.new_store(spark, path)
    monkeypatch.setattr(S, "ROWS_PER_TASK", 100)
    rows = spark.range(1000).selectExpr("'r' AS run_id", "'a' AS artifact_hash", "'dev' AS split", "id", "'x' AS label", "'y' AS prediction")
    S.append_predictions(rows, path, 0)
    # One artifact is one slot, whose rows are in ten parts over ten tasks.
    assert len(spark.read.parquet(f"{path}/rows/append=0").inputFiles()) > 4
    missing = spark.createDataFrame([(None, "a", "dev", 1, "x", "y")], S.ROW)
    later = rows.where("id % 2 = 0").unionByName(missing)
    change = S.append_predictions(later.withColumn("prediction", F.lit("x")), path, 1)
    assert {(r.run_id, r.prediction, r.n) for r in change.collect()} == {("r", "x", 500), ("r", "y", -500), (None, "x", 1)}
    again = S.append_predictions(missing, path, 2)
    assert [r.n for r in again.collect()] == [1]
    slot = rows.select(S._slot()).first()[0]
    old = S.replaced_rows(rows, path, 1, [slot])
    assert old.count() == 1000 and "Broadcast" not in old._jdf.queryExecution().executedPlan().toString()
    S.compact(spark, path)
    assert {(r.prediction, r.n) for r in S.current_cells(spark, path).where("run_id = 'r'").collect()} == {("x", 500), ("y", 500)}
