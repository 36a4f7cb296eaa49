"""Pairing artifacts with examples, scoring what is not cached, and turning scores into results.

Scoring every artifact of a run on every example of that run is the work itself: the pairs are the
rows of the prediction table. They come from an equi-join on the run and are streamed into the
scorer, never collected. A run's artifacts are broadcast only after their size has been measured;
otherwise both sides are spread over salts, so that a run holding most of the examples is split.
For scoring, the join makes one row per example and *block* of artifacts, and the pairs exist only
inside the scorer's task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.hashing import hash8
from evalspark.operators.keys import join_on
from evalspark.operators.ledger import hit_rate, ledger_of, unset_pairs
from evalspark.operators.metrics import KEYS, contingency, metrics_of_cells
from evalspark.plans.shared import settle, tidy

BROADCAST_BYTES = 32 * 1024 * 1024
PAIR_SALTS = 64
BLOCK_ARTIFACTS = 64
BLOCK_BYTES = 256 * 1024
SLOTS_PER_TASK = 32
# What an example costs besides its text, in bytes.
EXAMPLE_BYTES = 64
# Text that a chunk of examples holds at most (one example at least): as Python strings it takes up to four times as much.
CHUNK_BYTES = 8 * 1024 * 1024

# A scorer gets one artifact, a frame of examples (``id``, ``input``, ``label``) and the
# temperature of the attempt, and returns one prediction per example, in order.
Scorer = Callable[[str, pd.DataFrame, float], Sequence[str]]


def _measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes (string lengths, and eight per other column) in one pass; only numbers reach the driver."""
    width = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(name), F.lit(0)) + 16 if kind == "string" else F.lit(8))
    count, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return count, size


def _meet(small: DataFrame, examples: DataFrame, on: Sequence[str], size: int) -> DataFrame:
    """Equi-join of a run's artifacts (``size`` bytes in all) with its examples."""
    if size <= BROADCAST_BYTES:
        return examples.join(F.broadcast(small), list(on))
    salted = examples.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(PAIR_SALTS).cast("bigint")))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(PAIR_SALTS - 1).cast("bigint"))
    return salted.join(small.withColumn("_salt", F.explode(salts)), [*on, "_salt"]).drop("_salt")


def score_pairs(
    artifacts: DataFrame, examples: DataFrame, on: Sequence[str] = ("run_id",), tasks: int | None = None
) -> DataFrame:
    """Every artifact of a run with every example of the run, one row per pair.

    ``tasks`` spreads the examples over that many tasks first, for work on the pairs that is heavy
    where the examples come in few partitions.
    """
    if tasks:
        examples = examples.repartition(tasks, "id")
    return _meet(artifacts, examples, on, _measure(artifacts)[1])


PAIR_KEY = ("run_id", "artifact_hash", "split", "id")


def pending_pairs(artifacts: DataFrame, examples: DataFrame, cache: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Pairs (``PAIR_KEY``) that have no cached prediction: the missing bits of the cache's ledger.

    Finished artifacts make no pair rows. Without a ``ledger``, that of ``cache`` is built.
    """
    if ledger is None:
        ledger = ledger_of(cache)
    return unset_pairs(artifacts, examples, ledger).select(*PAIR_KEY)


def cache_hit_rate(artifacts: DataFrame, examples: DataFrame, cache: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Pairs, cached pairs and their share, per run, by counting bits."""
    return hit_rate(artifacts, examples, ledger_of(cache) if ledger is None else ledger)


def _blocks(artifacts: DataFrame) -> tuple[DataFrame, int]:
    """Artifacts of a run in blocks of about ``BLOCK_ARTIFACTS``, and the bytes of all of them.

    A block also holds about ``BLOCK_BYTES`` of text at most, so a block is a small value however
    many artifacts there are.
    """
    texts = artifacts.select("run_id", "artifact_hash", "artifact").distinct()
    _, size = _measure(texts)
    # The number of blocks follows from the run's own artifacts.
    number = F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ARTIFACTS), F.ceil(F.sum(F.coalesce(F.octet_length("artifact"), F.lit(0))) / BLOCK_BYTES), F.lit(1)
    )
    runs = texts.groupBy("run_id").agg(number.cast("bigint").alias("_blocks"))
    blocks = (
        join_on(texts, runs, ["run_id"], null_safe=True)
        .groupBy("run_id", F.pmod(F.xxhash64("artifact_hash"), F.col("_blocks")).alias("block"))
        .agg(F.collect_list(F.struct("artifact_hash", "artifact")).alias("artifacts"))
    )
    return blocks, size


WORK = ("run_id", "split", "id", "input", "label", "artifacts")


def _deal(costs: Sequence[float], tasks: int) -> list[int]:
    """A task for each item: the costliest first, each to the task that has least so far."""
    loads = [(0.0, task) for task in range(tasks)]
    out = [0] * len(costs)
    for item in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        load, task = heappop(loads)
        out[item] = task
        heappush(loads, (load + costs[item], task))
    return out


def balanced(rows: DataFrame, tasks: int, cost: Column, identity: Sequence[str]) -> DataFrame:
    """The rows over ``tasks`` partitions of about equal cost.

    Rows of more than a fifth of a task's share are items of their own, of which there are five per
    task at most; the others are summed in ``SLOTS_PER_TASK`` slots per task, by a hash. One aggregation
    gives the items' costs, and they are dealt out on the driver, the costliest first.
    """
    keyed = rows.withColumn("_cost", cost.cast("double")).withColumn("_item", F.xxhash64(*identity))
    total = keyed.agg(F.coalesce(F.sum("_cost"), F.lit(0.0))).first()[0]
    large = F.col("_cost") > total / tasks / 5
    keyed = keyed.withColumn("_large", large).withColumn("_item", F.when(large, F.col("_item")).otherwise(F.pmod("_item", F.lit(SLOTS_PER_TASK * tasks))))
    items = keyed.groupBy("_large", "_item").agg(F.sum("_cost").alias("_cost")).orderBy("_large", "_item").collect()
    dealt = zip(items, _deal([r["_cost"] for r in items], tasks), strict=True)
    table = rows.sparkSession.createDataFrame([(r["_large"], r["_item"], task) for r, task in dealt], "_large boolean, _item bigint, _task int")
    return keyed.join(table, ["_large", "_item"]).repartitionById(tasks, F.col("_task")).drop("_large", "_item", "_cost", "_task")


def _lines(examples: DataFrame, tasks: int | None) -> DataFrame:
    """Examples spread over the scoring tasks by the bytes of their texts, whatever files they come from.

    Scoring dominates everything else, so this one shuffle of the examples (not of the pairs)
    pays for itself; the number of tasks bounds the concurrent calls of the scorer.
    """
    tasks = tasks or int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cost = F.coalesce(F.octet_length("input"), F.lit(0)) + EXAMPLE_BYTES
    return balanced(examples.select("run_id", "split", "id", "input", "label"), tasks, cost, ["run_id", "split", "id"])


def scoring_work(artifacts: DataFrame, examples: DataFrame, tasks: int | None = None) -> DataFrame:
    """All pairs as work for the scorer: one row per example and block of artifacts.

    A pair costs its share of the block's and the example's text, not a copy of both.
    """
    blocks, size = _blocks(artifacts)
    return _meet(blocks, _lines(examples, tasks), ["run_id"], size).select(*WORK)


def pending_work(
    artifacts: DataFrame, examples: DataFrame, cache: DataFrame, tasks: int | None = None, ledger: DataFrame | None = None
) -> DataFrame:
    """Work for the pairs that have no cached prediction.

    Artifacts new to the cache are paired with all examples. For the others the pending pairs are
    found in the ledger, listed per example and block, and joined to the texts: an example's text is
    shuffled once, however many of its pairs are pending. Without a ``ledger``, that of ``cache`` is built.
    """
    artifacts = settle(artifacts.select("run_id", "artifact_hash", "artifact").distinct(), "artifacts")
    known = settle((cache if ledger is None else ledger).select("run_id", "artifact_hash").distinct(), "cached-artifacts")
    fresh = join_on(artifacts, known, ["run_id", "artifact_hash"], "left_anti")
    seen = join_on(artifacts, known, ["run_id", "artifact_hash"], "left_semi")
    if seen.isEmpty():
        return scoring_work(fresh, examples, tasks)
    blocks, size = _blocks(seen)
    members = blocks.select("run_id", "block", F.explode("artifacts.artifact_hash").alias("artifact_hash"))
    # A list holds at most the artifacts of one block.
    lists = (
        pending_pairs(seen, examples, cache, ledger).join(members, ["run_id", "artifact_hash"])
        .groupBy("run_id", "split", "id", "block").agg(F.collect_set("artifact_hash").alias("_open"))
    )
    texts = _meet(blocks, _lines(examples, tasks).join(lists, ["run_id", "split", "id"]), ["run_id", "block"], size)
    wanted = F.filter("artifacts", lambda a: F.array_contains("_open", a["artifact_hash"]))
    again = texts.withColumn("artifacts", wanted).select(*WORK)
    return again if fresh.isEmpty() else again.unionByName(scoring_work(fresh, examples, tasks))


def hash_scorer(pairs: DataFrame) -> DataFrame:
    """Deterministic test scorer as expressions: an artifact's accuracy follows from its hash.

    Right answers are the label, wrong ones ``wrong_<label>``. Each pair has its own hash, so the
    result does not depend on the order of the examples. No text is needed: the number of an
    artifact is the head of its content hash.
    """
    number = F.conv(F.substring("artifact_hash", 1, 8), 16, 10).cast("bigint")
    accuracy = F.least(
        F.lit(fixed.HASH_SCORER_CEILING),
        fixed.HASH_SCORER_BASE + fixed.HASH_SCORER_STEP * (number % fixed.HASH_SCORER_MODULUS),
    )
    draw = hash8(F.concat_ws(":", "artifact_hash", F.col("id").cast("string"))) % 1000
    wrong = F.concat(F.lit(fixed.WRONG_PREFIX), F.col("label"))
    return pairs.withColumn("prediction", F.when(draw < accuracy, F.col("label")).otherwise(wrong))


SCORED = "run_id string, artifact_hash string, split string, id bigint, label string, prediction string, error string"
ATTEMPTS = "run_id string, artifact_hash string, split string, id bigint, label string, attempt int, temperature double, prediction string, error string"
_PAIR = [("run_id", pa.string()), ("artifact_hash", pa.string()), ("split", pa.string()), ("id", pa.int64()), ("label", pa.string())]
_ANSWER = [("prediction", pa.string()), ("error", pa.string())]
SCORED_ROWS = pa.schema([*_PAIR, *_ANSWER])
ATTEMPT_ROWS = pa.schema([*_PAIR, ("attempt", pa.int32()), ("temperature", pa.float64()), *_ANSWER])


def _call(scorer: Scorer, artifact: str, chunk: pd.DataFrame, temperature: float) -> tuple[list, str | None]:
    """Predictions of one artifact for one chunk of examples, or the reason there are none."""
    try:
        found = list(scorer(artifact, chunk[["id", "input", "label"]], temperature))
    except Exception as problem:  # the error belongs to these rows, not to the job
        return [None] * len(chunk), f"{type(problem).__name__}: {problem}"
    if len(found) != len(chunk):
        return [None] * len(chunk), f"scorer returned {len(found)} predictions for {len(chunk)} examples"
    return [None if p is None else str(p) for p in found], None


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``CHUNK_BYTES`` of examples' text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("input")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, str, pd.DataFrame]]:
    """Hash and text of every artifact in a batch of work, with the examples it meets there, as strings for a part at a time."""
    for part in _parts(batch):
        yield from _part_chunks(part)


def _part_chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, str, pd.DataFrame]]:
    lists = batch.column("artifacts")
    examples = batch.drop_columns(["artifacts"]).to_pandas()
    members = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy()
    texts = pc.struct_field(members, "artifact")
    hashes = pc.struct_field(members, "artifact_hash").dictionary_encode()
    codes = hashes.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(part):
            yield hashes.dictionary[int(codes[part[0]])].as_py(), texts[int(part[0])].as_py(), examples.iloc[rows[part]]


def _rows(chunk: pd.DataFrame, schema: pa.Schema, **columns) -> pa.RecordBatch:
    frame = chunk[["run_id", "split", "id", "label"]].assign(**columns)
    return pa.RecordBatch.from_pandas(frame[schema.names], schema=schema, preserve_index=False)


def score(work: DataFrame, scorer: Scorer) -> DataFrame:
    """Run a user scorer over work; one row per pair, with an error instead of a raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, chunk in _chunks(batch):
                found, error = _call(scorer, text, chunk, fixed.RETRY_TEMPERATURES[0])
                yield _rows(chunk, SCORED_ROWS, artifact_hash=name, prediction=found, error=error)

    return work.select(*WORK).mapInArrow(tidy(run), SCORED)


def score_with_retries(
    work: DataFrame,
    scorer: Scorer,
    temperatures: Sequence[float] = fixed.RETRY_TEMPERATURES,
    max_retries: int = fixed.MAX_RETRIES,
) -> DataFrame:
    """Like ``score``, but failed rows are tried again at the next temperature; all attempts are kept.

    A row has failed if its prediction is null. The rows of a chunk that succeeded are not sent again.
    """
    schedule = list(temperatures)[:max_retries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, chunk in _chunks(batch):
                for attempt, temperature in enumerate(schedule, 1):
                    found, error = _call(scorer, text, chunk, temperature)
                    failed = np.array([p is None for p in found])
                    reasons = [(error or "no prediction") if f else None for f in failed]
                    yield _rows(
                        chunk, ATTEMPT_ROWS, artifact_hash=name, attempt=attempt, temperature=temperature,
                        prediction=found, error=reasons,
                    )
                    chunk = chunk[failed]
                    if chunk.empty:
                        break

    return work.select(*WORK).mapInArrow(tidy(run), ATTEMPTS)


def last_attempts(attempts: DataFrame) -> DataFrame:
    """One row per pair: its last attempt. Attempts per pair are few, and combine before the shuffle."""
    last = F.max_by(F.struct("label", "attempt", "temperature", "prediction", "error"), "attempt").alias("last")
    return attempts.groupBy(*PAIR_KEY).agg(last).select(*PAIR_KEY, "last.*")


def align_predictions(examples: DataFrame, predictions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Label and prediction of every pair, by id: a missing prediction is ``''``, a surplus one is dropped.

    Predictions take far less room in a file than in memory, so its size must not make them a broadcast: the join sorts.
    """
    pairs = score_pairs(
        artifacts.select("run_id", "artifact_hash"), examples.select("run_id", "split", "id", "label")
    )
    joined = join_on(pairs, predictions.select(*PAIR_KEY, "prediction").hint("merge"), list(PAIR_KEY), "left")
    return joined.select(*PAIR_KEY, "label", F.coalesce("prediction", F.lit("")).alias("prediction"))


def one_per_pair(cached: DataFrame) -> DataFrame:
    """Cached predictions without the copies that retried jobs leave: the smallest text per pair."""
    return cached.groupBy(*PAIR_KEY).agg(F.min("prediction").alias("prediction"))


def aligned_contingency(
    examples: DataFrame, scored: DataFrame, artifacts: DataFrame, cached: DataFrame | None = None
) -> DataFrame:
    """Contingency cells as if every pair had been aligned, without making the pairs.

    ``scored`` rows carry their label and are counted as they are. ``cached`` predictions meet
    their label by id first, so labels may have changed since they were cached. What the label
    counts of a split have more than those cells is what has no prediction: it is added as cells
    with prediction ``''``.
    """
    labels = examples.select("run_id", "split", "id", "label")
    wanted = artifacts.select("run_id", "artifact_hash").distinct()
    counted = contingency(scored.select(*KEYS, "label", F.coalesce("prediction", F.lit("")).alias("prediction")))
    if cached is not None:
        known = join_on(cached.select(*PAIR_KEY, "prediction"), wanted, ["run_id", "artifact_hash"], "left_semi")
        # One shuffle serves the copies and the labels; the cached rows are small as files only, so they are never broadcast.
        known = one_per_pair(known.repartition("run_id", "split", "id")).hint("merge")
        counted = counted.unionByName(contingency(join_on(known, labels, ["run_id", "split", "id"])))
    counted = settle(counted, "aligned-cells")
    expected = join_on(
        wanted, labels.groupBy("run_id", "split", "label").agg(F.count(F.lit(1)).alias("_all")), ["run_id"]
    )
    found = counted.groupBy(*KEYS, "label").agg(F.sum("n").alias("_found"))
    missing = join_on(expected, found, [*KEYS, "label"], "left", null_safe=True).select(
        *KEYS, "label", F.lit("").alias("prediction"),
        (F.col("_all") - F.coalesce("_found", F.lit(0))).alias("n"),
    )
    both = counted.unionByName(missing.where(F.col("n") > 0))
    return both.groupBy(*KEYS, "label", "prediction").agg(F.sum("n").alias("n"))


def scoring_results(
    examples: DataFrame,
    scored: DataFrame,
    artifacts: DataFrame,
    cached: DataFrame | None = None,
    label_order: dict[str, int] | None = None,
) -> DataFrame:
    """One row per run, artifact and split: metrics, success and error.

    A group with any scoring error fails as a whole: its metrics are 0.0 and the first error text
    (in text order) is reported.
    """
    keys = list(KEYS)
    good_rows = scored.where(F.col("error").isNull())
    metrics = metrics_of_cells(aligned_contingency(examples, good_rows, artifacts, cached), keys, label_order)
    errors = scored.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.min("error").alias("error"))
    joined = join_on(metrics, errors, keys, "left")
    good = F.col("error").isNull()
    return joined.select(
        *keys,
        *[F.when(good, F.col(m)).otherwise(0.0).alias(m) for m in fixed.METRIC_SYMBOLS],
        good.alias("success"),
        "error",
    )


def response_health(attempts: DataFrame, text: str = "text") -> DataFrame:
    """Flags of one response: length, thinking tags, a prompt, and whether it was cut off.

    A response is truncated if a tag that was opened is never closed.
    """
    low = F.lower(text)
    think, closed = F.contains(low, F.lit("<think>")), F.contains(low, F.lit("</think>"))
    prompt = F.contains(F.col(text), F.lit("<PROMPT>"))
    prompt_closed = F.contains(F.col(text), F.lit("</PROMPT>"))
    return attempts.select(
        *[c for c in attempts.columns if c != text],
        F.length(text).cast("bigint").alias("length"),
        think.alias("has_think"),
        closed.alias("think_closed"),
        (prompt & prompt_closed).alias("has_prompt"),
        ((think & ~closed) | (prompt & ~prompt_closed)).alias("truncated"),
    )


def response_rates(health: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of responses and share of each flag."""
    share = lambda flag: F.avg(F.col(flag).cast("int")).alias(f"{flag}_rate")
    return health.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        F.max("length").alias("longest"),
        *[share(f) for f in ("has_think", "think_closed", "has_prompt", "truncated")],
    )
