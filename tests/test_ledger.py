"""The bitmap ledger against sets of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import ledger as H
from evalspark.operators import scoring as C
from evalspark.plans.shared import new_folder
from evalspark.sources import cache as K

IDS = [0, 1, 7, 8, 9, 255, 256, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12, -1, -32_768, -40_000]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    examples = [(r, rng.choice(["train", "dev"]), i) for r in ("p", "q") for i in IDS + rng.sample(range(300, 70_000), 60)]
    artifacts = [(r, f"a{k}") for r in ("p", "q") for k in range(5)]
    pairs = [(r, a, s, i) for r, a in artifacts for x, s, i in examples if x == r]
    # a0 is finished, a1 has nothing, the others have some; there are surplus rows and copies.
    cached = [p for p in pairs if p[1] == "a0" or (p[1] not in ("a0", "a1") and rng.random() < 0.6)]
    extra = [("p", "a0", "train", 999_999), ("q", "gone", "dev", 1), ("r", "a0", "dev", 1)] + cached[:30]
    frames = {
        "examples": spark.createDataFrame(examples, "run_id string, split string, id bigint"),
        "artifacts": spark.createDataFrame(artifacts, "run_id string, artifact_hash string"),
        "cache": spark.createDataFrame([(a, s, i, "x", r, None) for r, a, s, i in cached + extra], "artifact_hash string, split string, id bigint, prediction string, run_id string, error string"),
    }
    return frames, set(pairs), set(cached)


def test_missing_bits_are_the_pending_pairs(world, rows):
    frames, pairs, cached = world
    args = frames["artifacts"], frames["examples"]
    ledger = H.ledger_of(frames["cache"])
    assert {tuple(r) for r in C.pending_pairs(*args, ledger=ledger).collect()} == pairs - cached
    assert rows(C.pending_pairs(*args, frames["cache"])) == sorted(pairs - cached, key=repr)
    rates = {r.run_id: (r.pairs, r.hits) for r in C.cache_hit_rate(*args, ledger=ledger).collect()}
    assert rates == {run: (sum(p[0] == run for p in pairs), sum(p[0] == run for p in cached)) for run in "pq"}
    empty = frames["cache"].limit(0)
    assert C.pending_pairs(*args, empty).count() == len(pairs)
    assert C.pending_pairs(frames["artifacts"].limit(0), frames["examples"], frames["cache"]).count() == 0
    # Rows listed twice: a pair is asked for once per row of the examples.
    assert C.pending_pairs(frames["artifacts"].union(frames["artifacts"]), frames["examples"], ledger=ledger).count() == len(pairs - cached)


def test_finished_artifacts_make_no_pair_rows(world, monkeypatch):
    frames, pairs, cached = world
    seen = []
    settle = H.settle
    monkeypatch.setattr(H, "settle", lambda df, name: seen.append((name, settle(df, name))) or seen[-1][1])
    H.unset_pairs(frames["artifacts"], frames["examples"], H.ledger_of(frames["cache"]))
    unfinished = dict(seen)["unfinished-bits"]
    assert unfinished.where("artifact_hash = 'a0'").count() == 0
    buckets = {(r, a, s, 1 + (i - 1) // 32_768 if i > 0 else -(-i // 32_768)) for r, a, s, i in pairs - cached}
    assert unfinished.count() == len(buckets)


def test_the_ledger_follows_appends_and_can_be_rebuilt(spark, world):
    frames, _, _ = world
    path = new_folder(spark, "cache")
    parts = frames["cache"].randomSplit([0.3, 0.3, 0.4], 1)
    for part in (*parts, parts[1]):  # one append is repeated
        K.append_cache(part, path)
    K.append_cache(frames["cache"].withColumn("error", F.lit("bad")).withColumn("id", F.col("id") + 5), path)
    bits = lambda ledger: {tuple(r[c] for c in H.LEDGER_KEY): bytes(r.bits) for r in ledger.collect()}
    want = bits(H.ledger_of(frames["cache"]))
    assert bits(H.united(K.read_ledger(spark, path))) == want
    rebuilt = K.rebuild_ledger(spark, path)
    assert rebuilt.count() == len(want) and bits(rebuilt) == want
    assert bits(H.ledger_of(K.read_cache(spark, path))) == want


def test_bits_of_single_ids(spark):
    df = spark.createDataFrame([("r", "a", "s", i) for i in IDS], "run_id string, artifact_hash string, split string, id bigint")
    ledger = H.ledger_of(df.where("id % 2 = 0"))
    spots = df.withColumn("bucket", F.bitmap_bucket_number("id")).join(ledger, ["run_id", "artifact_hash", "split", "bucket"], "left")
    assert {r.id for r in spots.where(H.bit_is_set(F.col("bits"), F.col("id"))).collect()} == {i for i in IDS if i % 2 == 0}
