import pytest
from pyspark.sql import functions as F

from evalspark.functions.hashing import sha16
from evalspark.operators import diagnosis as D
from evalspark.operators import scoring as C
from evalspark.operators.keys import join_on
from evalspark.plans.shared import new_folder, settle
from evalspark.sources import cache as K
from evalspark.streaming import score_stream as RS


@pytest.fixture(scope="module")
def artifacts(spark):
    data = [("r", "Prompt A"), ("r", "Prompt B"), ("q", "Prompt A")]
    return spark.createDataFrame(data, "run_id string, artifact string").withColumn("artifact_hash", sha16("artifact"))


@pytest.fixture(scope="module")
def examples(spark):
    data = [(r, s, i, f"text {i}", "AB"[i % 2]) for r in "rq" for i, s in enumerate(["train", "dev", "test"] * 4)]
    return spark.createDataFrame(data, "run_id string, split string, id bigint, input string, label string")


def _scorer():
    # A nested function travels to the workers by value; this test module is not installed there.
    def by_text(artifact, chunk, temperature):
        return ["A" if artifact.endswith("A") else y for y in chunk["label"]]

    return by_text


by_text = _scorer()


def test_pairs_do_not_depend_on_the_plan(artifacts, examples, rows, monkeypatch):
    keys = ("run_id", "artifact_hash", "split", "id")
    broadcast = rows(C.score_pairs(artifacts, examples), *keys)
    work = rows(C.score(C.scoring_work(artifacts, examples), by_text))
    monkeypatch.setattr(C, "BROADCAST_BYTES", -1)
    salted = C.score_pairs(artifacts, examples)
    assert "Cartesian" not in salted._jdf.queryExecution().executedPlan().toString()
    assert rows(salted, *keys) == broadcast and len(broadcast) == 36
    assert rows(C.score(C.scoring_work(artifacts, examples), by_text)) == work
    monkeypatch.setattr(C, "BLOCK_ARTIFACTS", 1)
    assert rows(C.score(C.scoring_work(artifacts, examples), by_text)) == work


def test_scoring_reports_errors_per_artifact(artifacts, examples):
    def partly(artifact, chunk, temperature):
        if artifact == "Prompt B":
            raise RuntimeError("no answer")
        return list(chunk["label"])

    def short(artifact, chunk, temperature):
        return ["A"]

    scored = C.score(C.scoring_work(artifacts, examples), partly)
    results = {(r.run_id, r.artifact_hash, r.split): r for r in C.scoring_results(examples, scored, artifacts).collect()}
    bad = artifacts.where("artifact = 'Prompt B'").first().artifact_hash
    assert len(results) == 9
    for (_, name, _), r in results.items():
        if name == bad:
            assert not r.success and r.error == "RuntimeError: no answer" and (r.kappa, r.f1, r.spearman) == (0.0, 0.0, 0.0)
        else:
            assert r.success and r.error is None and r.kappa == 1.0
    wrong = C.score(C.scoring_work(artifacts, examples.limit(6)), short).where("error is not null")
    assert wrong.count() > 0


def test_missing_predictions_are_empty(artifacts, examples, rows):
    scored = C.score(C.scoring_work(artifacts, examples), by_text).where("id > 5")
    aligned = C.align_predictions(examples, scored.withColumn("id", F.col("id")), artifacts)
    from evalspark.operators.metrics import contingency

    direct = rows(contingency(aligned), "run_id", "artifact_hash", "split", "label", "prediction", "n")
    counted = C.aligned_contingency(examples, scored, artifacts)
    assert rows(counted, "run_id", "artifact_hash", "split", "label", "prediction", "n") == direct
    cached = C.aligned_contingency(examples, scored.where("id > 8"), artifacts, scored.where("id <= 8"))
    assert rows(cached, "run_id", "artifact_hash", "split", "label", "prediction", "n") == direct
    assert sum(r[-1] for r in direct) == 36 and any(r[4] == "" for r in direct)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_aligned_predictions_are_not_broadcast(spark, artifacts, examples, rows):
    scored = settle(C.score(C.scoring_work(artifacts, examples), by_text).where("id > 5"), "test-predictions")
    aligned = C.align_predictions(examples, scored, artifacts)
    # The only broadcast is that of the artifacts, whose size was measured.
    assert _plan(aligned).count("BroadcastExchange") == 1 and "SortMergeJoin" in _plan(aligned)
    found = rows(aligned.where("id > 5"), *C.PAIR_KEY, "label", "prediction")
    assert aligned.count() == 36 and found == rows(scored, *C.PAIR_KEY, "label", "prediction")
    assert aligned.where("id <= 5 and prediction <> ''").isEmpty()


def test_cached_predictions_are_not_broadcast(spark, artifacts, examples, rows):
    scored = settle(C.score(C.scoring_work(artifacts, examples), by_text), "test-predictions")
    path = new_folder(spark, "test-stream-cache")
    lines = settle(examples, "test-examples")
    seen = []
    settled = C.settle
    try:
        C.settle = lambda df, name: (seen.append(_plan(df)), settled(df, name))[1]
        cells = rows(C.aligned_contingency(lines, scored.limit(0), settle(artifacts, "test-artifacts"), scored))
    finally:
        C.settle = settled
    assert sum(r[-1] for r in cells) == 36 and "SortMergeJoin" in seen[0]
    RS.empty_cache(spark).write.parquet(f"{path}/micro_batch=-1")
    scored.where("id > 5").select("artifact_hash", "split", "id", "prediction", "run_id").write.parquet(f"{path}/micro_batch=1")
    errors = join_on(scored, artifacts.select("run_id", "artifact_hash", "artifact"), ["run_id", "artifact_hash"]).withColumn("error", F.lit("late"))
    errors.select("run_id", "artifact_hash", "artifact", "split", "id", "label", "error").write.parquet(f"{path}-errors/micro_batch=0")
    failed = RS.failed_predictions(spark, path)
    assert "Broadcast" not in _plan(failed)
    assert rows(failed, *C.PAIR_KEY) == rows(scored.where("id <= 5"), *C.PAIR_KEY)


def test_cache_skips_what_is_scored(spark, artifacts, examples, rows):
    path = new_folder(spark, "test-cache")
    first = artifacts.where("artifact = 'Prompt A'")
    K.score_artifacts(first, examples.where("split <> 'dev'"), by_text, K.empty_cache(spark), path).collect()
    cache = K.read_cache(spark, path)
    assert cache.count() == 16
    pending = C.pending_pairs(artifacts, examples, cache)
    work = C.pending_work(artifacts, examples, cache)
    sent = C.score(work, by_text).select(*C.PAIR_KEY)
    assert pending.count() == 20 and rows(sent) == rows(pending)
    whole = rows(K.score_artifacts(artifacts, examples, by_text, K.empty_cache(spark)))
    assert rows(K.score_artifacts(artifacts, examples, by_text, cache, path)) == whole
    again = K.read_cache(spark, path)
    assert again.count() == 36 and C.pending_pairs(artifacts, examples, again).isEmpty()
    rate = {r.run_id: r.hit_rate for r in C.cache_hit_rate(artifacts, examples, again).collect()}
    assert rate == {"r": 1.0, "q": 1.0}


def test_failed_rows_are_not_cached(spark, artifacts, examples):
    def broken(artifact, chunk, temperature):
        raise ValueError("down")

    path = new_folder(spark, "test-cache")
    out = K.score_artifacts(artifacts, examples, broken, K.empty_cache(spark), path)
    assert out.where("success").count() == 0
    assert C.pending_pairs(artifacts, examples, K.read_cache(spark, path)).count() == 36


def test_copies_in_the_cache_collapse(spark, artifacts, examples, rows):
    path = new_folder(spark, "test-cache")
    scored = C.score(C.scoring_work(artifacts, examples), by_text)
    K.append_cache(scored, path)
    once = rows(C.aligned_contingency(examples, scored.limit(0), artifacts, K.read_cache(spark, path)))
    K.append_cache(scored, path)
    cache = K.read_cache(spark, path)
    assert cache.count() == 72 and C.one_per_pair(cache).count() == 36
    assert rows(C.aligned_contingency(examples, scored.limit(0), artifacts, cache)) == once
    assert C.pending_pairs(artifacts, examples, cache).isEmpty()
    K.append_artifacts(artifacts, path + "-artifacts")
    K.append_artifacts(artifacts, path + "-artifacts")
    assert sorted(r.artifact for r in K.read_artifacts(spark, path + "-artifacts").collect()) == ["Prompt A", "Prompt B"]


def test_retries_follow_the_temperatures(artifacts, examples):
    def warm(artifact, chunk, temperature):
        return [y if temperature >= 0.7 or i % 2 else None for i, y in zip(chunk["id"], chunk["label"])]

    tries = C.score_with_retries(C.scoring_work(artifacts, examples), warm)
    seen = {}
    for r in tries.collect():
        seen.setdefault((r.run_id, r.artifact_hash, r.id), []).append((r.attempt, r.temperature, r.prediction, r.error))
    for (_, _, i), attempts in seen.items():
        assert [a[:2] for a in attempts] == ([(1, 0.0)] if i % 2 else [(1, 0.0), (2, 0.4), (3, 0.7)])
        assert [a[3] for a in attempts[:-1]] == ["no prediction"] * (len(attempts) - 1) and attempts[-1][3] is None
    last = C.last_attempts(tries)
    assert last.count() == 36 and last.where("prediction is null").isEmpty()

    def never(artifact, chunk, temperature):
        raise OSError("gone")

    lost = C.score_with_retries(C.scoring_work(artifacts, examples), never)
    assert lost.count() == 36 * 4 and {r.error for r in lost.select("error").distinct().collect()} == {"OSError: gone"}


def test_hash_scorer_as_expression_and_as_function(artifacts, examples, rows):
    from evalspark.plans.bindings import hash_scorer_function

    keys = ("run_id", "artifact_hash", "split", "id", "prediction")
    expression = rows(C.hash_scorer(C.score_pairs(artifacts, examples)), *keys)
    assert rows(C.score(C.scoring_work(artifacts, examples), hash_scorer_function), *keys) == expression


def test_error_samples_and_digest(spark):
    keys = "run_id string, artifact_hash string, split string, id bigint, label string, prediction string"
    data = [("r", "h", "dev", i, "A", "B" if i < 30 else "C") for i in range(33)] + [("r", "h", "dev", 99, "A", "A")]
    predictions = spark.createDataFrame(data, keys)
    inputs = spark.createDataFrame([("r", i, "x" * 600) for i in range(100)], "run_id string, id bigint, input string")
    first = D.error_samples(predictions, inputs, n_samples=10).orderBy("sample").collect()
    assert [r.id for r in first] == list(range(10)) and {len(r.input) for r in first} == {500}
    balanced = D.balanced_errors(predictions, inputs, n_samples=5).orderBy("sample").collect()
    assert [(r.prediction, r.id) for r in balanced] == [("B", 0), ("C", 30), ("B", 1), ("C", 31), ("B", 2)]
    kinds = {r.prediction: (r.n, r.share) for r in D.error_types(predictions).collect()}
    assert kinds == {"B": (30, pytest.approx(30 / 33)), "C": (3, pytest.approx(3 / 33))}
    digest = D.error_digest(D.error_samples(predictions, inputs, n_samples=12)).first().digest
    assert digest.startswith("Example 1:\n  Input: " + "x" * 200 + "\n  Prediction: B\n  Ground Truth: A\nExample 2:")
    assert digest.count("Example") == 10


def test_response_health(spark):
    texts = ["<think>a", "<THINK>a</think><PROMPT>b</PROMPT>", "plain", "<PROMPT>cut"]
    found = C.response_health(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    assert [(r.has_think, r.think_closed, r.has_prompt, r.truncated) for r in found] == [
        (True, False, False, True), (True, True, True, False), (False, False, False, False), (False, False, False, True),
    ]
    assert [r.length for r in found] == [len(t) for t in texts]
    rates = C.response_rates(C.response_health(spark.createDataFrame([("a", t) for t in texts], "k string, text string")), ["k"]).first()
    assert (rates.responses, rates.truncated_rate) == (4, 0.5)


def test_examples_are_dealt_by_the_bytes_of_their_texts(spark, artifacts, rows):
    """Text sizes that span five orders of magnitude: no task has 1.2 times the mean, and no row is lost or doubled."""
    sizes = [int(1.13 ** (k % 100)) for k in range(3000)]
    data = [("rq"[k % 2], "dev", k, "x" * n, "A") for k, n in enumerate(sizes)]
    examples = spark.createDataFrame(data, "run_id string, split string, id bigint, input string, label string")
    lines = C._lines(examples, 8)
    assert rows(lines.select("run_id", "id")) == rows(examples.select("run_id", "id"))
    load = lambda df: [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("input") + C.EXAMPLE_BYTES)).select("sum((length(input) + 64))").collect()]
    loads = load(lines)
    assert len(loads) == 8 and max(loads) < 1.2 * sum(loads) / 8
    # One text of half of all bytes has a task of its own.
    huge = examples.unionByName(spark.createDataFrame([("r", "dev", 9999, "y" * sum(sizes), "A")], examples.schema))
    assert sorted(load(C._lines(huge, 8)))[-1] < 1.01 * (sum(sizes) + C.EXAMPLE_BYTES)
    assert C._lines(examples.limit(0), 8).count() == 0
    assert rows(C.score(C.scoring_work(artifacts, examples, 8), by_text)) == rows(C.score(C.scoring_work(artifacts, examples, 3), by_text))


def test_the_costliest_items_are_dealt_first():
    costs = [1, 9, 5, 5, 8]
    tasks = C._deal(costs, 2)
    assert sorted(sum(c for c, t in zip(costs, tasks, strict=True) if t == k) for k in (0, 1)) == [14, 14]
    assert C._deal([], 4) == []


def test_chunks_hold_little_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "CHUNK_BYTES", 1000, raising=False)
    texts = ["x" * 400] * 5 + [None, "é" * 2000, ""] + ["y"] * 4
    blocks = [[{"artifact_hash": h, "artifact": f"text {h}"} for h in "ab"[: 1 + k % 2]] for k in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({
        "run_id": ["r"] * len(texts), "split": ["dev"] * len(texts), "id": list(range(len(texts))), "input": texts,
        "label": ["A"] * len(texts), "artifacts": blocks,
    })
    found = list(C._chunks(batch))
    for name, text, chunk in found:
        assert text == f"text {name}" and (len(chunk) == 1 or sum(len((t or "").encode()) for t in chunk["input"]) <= 1000)
    pairs = sorted((i, name) for name, _, chunk in found for i in chunk["id"])
    assert pairs == [(k, m["artifact_hash"]) for k, block in enumerate(blocks) for m in block]
    assert [t for _, _, chunk in found for t in chunk["input"][chunk["id"] == 5]] == [None, None]
    assert list(C._chunks(batch.slice(0, 0))) == []
