import os

from pyspark.sql import functions as F

from evalspark.functions.hashing import sha16
from evalspark.operators.scoring import PAIR_KEY, score_pairs
from evalspark.streaming import log_stream as R
from evalspark.streaming import score_stream as RS

LINE = '{"run_id":"r","iter":%d,"batch":%d,"ts":"2024-01-01T00:%02d:00","plan_id":"p%d","metrics_dev":{"kappa":%f}}'


def put(folder, name, entries, at):
    """Write a log file with a modification time of its own, since files are taken in that order."""
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(LINE % (i, (i - 1) // 5 + 1, m, i % 3, k) for i, m, k in entries) + "\n")
    os.utime(path, (at, at))


def test_progress_survives_restarts(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    put(log, "a.json", [(i, i, i / 10) for i in range(1, 8)], 1_000)
    run = lambda: R.write_upserts(R.batch_progress(R.log_stream(spark, str(log))), out, state).awaitTermination()
    read = lambda: {tuple(r) for r in R.read_upserts(spark, out, ["run_id", "batch"]).collect()}
    run()
    assert read() == {("r", 1, 5, 0.5), ("r", 2, 2, 0.7)}
    run()  # nothing new
    put(log, "b.json", [(i, i, 0.1) for i in range(8, 12)], 2_000)
    run()
    assert read() == {("r", 1, 5, 0.5), ("r", 2, 5, 0.7), ("r", 3, 1, 0.1)}
    best = R.best_so_far(R.read_upserts(spark, out, ["run_id", "batch"])).orderBy("batch").collect()
    assert [r.best_so_far for r in best] == [0.5, 0.7, 0.7]


def folders(path):
    return {name: sorted(int(x.split("=")[1]) for x in os.listdir(f"{path}/{name}") if "=" in x) if os.path.exists(f"{path}/{name}") else [] for name in ("changes", "generations", "pointer")}


def test_upserts_are_compacted_into_generations(spark, tmp_path, monkeypatch):
    """The newest rows stay the same whatever happens on the way, and old folders go."""
    path, keys, want = str(tmp_path / "out"), ["k"], {}
    read = lambda: {r.k: (r.v, r.w) for r in R.read_upserts(spark, path, keys).collect()}
    change = lambda b: [(b % 3, b, None if b % 2 else "x"), (100 + b, b, "y")]

    def step(batch):
        R.upsert(spark.createDataFrame(change(batch), "k int, v int, w string").coalesce(1), batch, path, keys, compact_every=4)
        want.update({k: (v, w) for k, v, w in change(batch)})

    for batch in range(9):
        step(batch)
        assert read() == want
    assert folders(path) == {"changes": [8], "generations": [7], "pointer": [7]}
    step(8)  # a repeated micro-batch
    # A job that ends while it writes the next generation: the pointer still names the one before.
    for batch in (9, 10):
        step(batch)
    monkeypatch.setattr(R, "_delete", lambda *a: 1 / 0)
    spark.createDataFrame([(0, 0, "half")], "k int, v int, w string").write.parquet(f"{path}/generations/upto=11")
    assert read() == want
    try:
        step(11)
    except ZeroDivisionError:
        pass
    want.update({k: (v, w) for k, v, w in change(11)})
    assert read() == want  # switched, though nothing old is deleted yet
    monkeypatch.undo()
    R.compact_upserts(spark, path, keys, 11)  # nothing to do
    for batch in range(12, 17):
        step(batch)
    assert read() == want and folders(path) == {"changes": [16], "generations": [15], "pointer": [15]}


def test_late_rows_correct_closed_windows(spark, tmp_path):
    """Three files, of which two bring rows out of order; a restart in between."""
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: R.write_windows(R.log_stream(spark, str(log), files_per_batch=1), out, state).awaitTermination()
    read = lambda: {(r.m, r.plan_id): (r.proposals, r.unstreamed, r.closed) for r in R.counted_windows(spark, out).withColumn("m", F.minute("window_start")).collect()}
    put(log, "a.json", [(1, 0, 0.1), (4, 5, 0.1), (7, 20, 0.1)], 1_000)
    run()
    assert read() == {(0, "p1"): (1, 0, True), (5, "p1"): (1, 0, True), (20, "p1"): (1, 0, False)}
    # The watermark stands at 10: minutes 5 and 9 are late, 10 and 12 are not.
    put(log, "b.json", [(10, 5, 0.1), (11, 9, 0.1), (13, 10, 0.1), (16, 12, 0.1), (19, 40, 0.1)], 2_000)
    put(log, "c.json", [(22, 20, 0.1), (25, 29, 0.1), (28, 30, 0.1)], 3_000)
    run()
    want = {
        (0, "p1"): (1, 0, True), (5, "p1"): (2, 1, True), (9, "p2"): (1, 1, True), (10, "p1"): (1, 0, True), (12, "p1"): (1, 0, True),
        (20, "p1"): (2, 1, True), (29, "p1"): (1, 1, True), (30, "p1"): (1, 0, False), (40, "p1"): (1, 0, False),
    }
    assert read() == want
    assert sorted((r.iter, r.micro_batch) for r in R.late_rows(spark, out).collect()) == [(10, 1), (11, 1), (22, 2), (25, 2)]
    run()  # nothing new
    assert read() == want
    # What is counted is what all rows give, without reading them again.
    every = R.proposals_per_window(spark.read.schema(R.LOG_ROW).json(str(log)).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(r.proposals for r in every.collect()) == sorted(n for n, _, _ in want.values())


def test_windows_close_with_the_watermark(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    put(log, "a.json", [(i, m, 0.1) for i, m in enumerate([0, 0, 5, 20], 1)], 1_000)
    windows = R.proposals_per_window(R.log_stream(spark, str(log)))
    R.write_appends(windows, out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.schema(windows.schema).parquet(out).groupBy(F.minute("window_start").alias("m")).agg(F.sum("proposals").alias("n")).collect()
    # The watermark stands at 00:10, so the window of minute 20 is still open.
    assert {(r.m, r.n) for r in found} == {(0, 2), (5, 1)}


def test_replayed_rows_are_dropped(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    put(log, "a.json", [(i, i, 0.1) for i in range(1, 6)], 1_000)
    put(log, "b.json", [(i, i, 0.1) for i in (2, 3, 6, 7)], 2_000)
    rows = R.deduplicated(R.log_stream(spark, str(log), files_per_batch=1), "1 day").select("run_id", "iter")
    R.write_appends(rows, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.iter for r in spark.read.schema(rows.schema).parquet(out).collect()) == list(range(1, 8))


def test_arriving_artifacts_are_scored_once(spark, tmp_path, rows):
    examples = spark.createDataFrame(
        [("r", s, i, "x", "A") for i, s in enumerate(["train", "dev", "test"])], "run_id string, split string, id bigint, input string, label string"
    )
    calls = spark.sparkContext.accumulator(0)

    def scorer(artifact, chunk, temperature):
        calls.add(len(chunk))
        return list(chunk["label"])

    texts = lambda *t: spark.createDataFrame([("r", x) for x in t], "run_id string, artifact string").select("run_id", sha16("artifact").alias("artifact_hash"), "artifact")
    files, cache, state = str(tmp_path / "files"), str(tmp_path / "cache"), str(tmp_path / "state")
    stream = lambda: RS.stream_scores(spark.readStream.schema(texts("a").schema).parquet(files), examples, scorer, cache, state)
    texts("a", "b").write.parquet(files)
    stream().awaitTermination()
    texts("b", "c").write.mode("append").parquet(files)
    stream().awaitTermination()
    have = RS.cached_predictions(spark, cache)
    assert rows(have.select(*PAIR_KEY)) == rows(score_pairs(texts("a", "b", "c").drop("artifact"), examples), *PAIR_KEY)
    assert calls.value == 9
