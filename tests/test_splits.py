import hashlib
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.hashing import hash8, order_key, sha16
from evalspark.operators import splits as S

SAMPLE = {"math": 6, "geography": 4, "science": 5, "literature": 4, "art": 1}


def examples(spark, sizes):
    data = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(data, "id bigint, domain string")


def counts(df):
    return {(r.domain, r.split): r["count"] for r in df.groupBy("domain", "split").count().collect()}


def test_hashes(spark):
    row = spark.createDataFrame([("Prompt A",)], "t string").select(sha16("t"), hash8("t"), order_key("t")).first()
    full = hashlib.sha256(b"Prompt A").hexdigest()
    assert row[0] == full[:16] and row[1] == int(full[:8], 16)
    assert row[2] == hashlib.sha256(b"42:Prompt A").hexdigest()


def test_singleton_stratum_and_small_strata(spark):
    found = counts(S.stratified_split(examples(spark, SAMPLE)))
    want = {"math": (3, 1, 2), "geography": (1, 1, 2), "science": (2, 1, 2), "literature": (1, 1, 2), "art": (1, 0, 0)}
    for domain, sizes in want.items():
        assert tuple(found.get((domain, s), 0) for s in ("train", "dev", "test")) == sizes


def test_hundred_rows(spark):
    split = S.stratified_split(examples(spark, {"math": 33, "science": 33, "history": 34}))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 40, "dev": 20, "test": 40}
    gaps = [r.largest_gap for r in S.split_balance(split).collect()]
    assert len(gaps) == 3 and max(gaps) < 0.1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", None]), st.integers(1, 60), min_size=1))
def test_split_is_whole_exact_and_stable(spark, sizes):
    df = examples(spark, sizes)
    one = {(r.id, r.split) for r in S.stratified_split(df.repartition(1)).collect()}
    two = {(r.id, r.split) for r in S.stratified_split(df.repartition(5, F.rand())).collect()}
    assert one == two
    n = sum(sizes.values())
    assert sorted(i for i, _ in one) == list(range(n))
    test = math.ceil(n * 400 / 1000)
    dev = math.ceil((n - test) * 200 / 600)
    have = [sum(s == w for _, s in one) for w in ("test", "dev", "train")]
    assert have == [test, dev, n - test - dev]
    # No stratum is further than one row from its proportional share of what is kept.
    for stratum, size in sizes.items():
        ids = {r.id for r in df.where(F.col("domain").eqNullSafe(stratum)).collect()}
        kept = sum(1 for i, s in one if i in ids and s != "test")
        assert abs(kept - size * (n - test) / n) < 1


def test_members_follow_the_order_key(spark):
    df = examples(spark, {"a": 50})
    split = {r.id: r.split for r in S.stratified_split(df).collect()}
    ranked = sorted(range(50), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
    assert [split[i] for i in ranked] == ["test"] * 20 + ["dev"] * 10 + ["train"] * 20


def test_split_per_dataset(spark):
    df = examples(spark, {"a": 30, "b": 10}).withColumn("run", F.col("id") % 2)
    sizes = S.stratified_split(df, by=["run"]).groupBy("run", "split").count().collect()
    assert {(r.run, r.split): r["count"] for r in sizes} == {(r, s): n for r in (0, 1) for s, n in (("train", 8), ("dev", 4), ("test", 8))}


def test_subsample_is_exact(spark):
    df = examples(spark, {"a": 200})
    ranked = sorted(range(200), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
    for limit in (0, 1, 17, 199, 200, 500):
        assert {r.id for r in S.subsample(df, limit).collect()} == set(ranked[:limit])


def test_hash_split_needs_no_shuffle(spark):
    df = S.hash_split(spark.range(3000))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    shares = {r.split: r["count"] / 3000 for r in df.groupBy("split").count().collect()}
    assert shares == {"train": pytest.approx(0.4, abs=0.04), "dev": pytest.approx(0.2, abs=0.04), "test": pytest.approx(0.4, abs=0.04)}


def test_statistics(spark):
    data = [("train", "math"), ("train", "math"), ("train", "science"), ("dev", "math"), ("dev", "science"), ("test", "math"), ("test", "science"), ("test", None)]
    stats = {(r.split, r.domain): r for r in S.split_statistics(spark.createDataFrame(data, "split string, domain string")).collect()}
    assert stats["train", "math"].share == pytest.approx(2 / 3)
    assert stats["test", "math"].share == 0.5 and stats["test", "math"].split_rows == 3
    assert stats["overall", "math"].n == 4 and stats["overall", "math"].share == pytest.approx(4 / 7)


def test_gates_and_rare_strata(spark):
    artifacts = spark.createDataFrame([("é" * 60_000,)], "artifact string")
    found = {r.gate: (r.value, r.status) for r in S.dataset_gates(spark.range(250), artifacts).collect()}
    assert found == {"examples": (250, "few"), "artifact_bytes": (120_000, "too large")}
    assert [tuple(r) for r in S.rare_strata(examples(spark, SAMPLE)).collect()] == [("art", 1)]


def test_rank_cuts_narrow_until_few_rows_are_left(spark):
    """One digit a round and one row a cut: several rounds, and the same keys as sorting."""
    from evalspark.operators.ranking import prefix_histogram, rank_cutoffs

    data = [("g" if i % 4 else None, f"{(i * 7919) % 65536:04x}") for i in range(400)]
    df = spark.createDataFrame(data, "g string, key string")
    cuts = [("g", "low", 1), ("g", "middle", 150), ("g", "high", 300), (None, "low", 37), (None, "none", 0)]
    histogram = prefix_histogram(df, ["g"], "key", digits=1)
    found = rank_cutoffs(df, ["g"], "key", spark.createDataFrame(cuts, "g string, cut string, rank bigint"), histogram, digits=1, rows=1)
    ordered = {g: sorted(k for h, k in data if h == g) for g in ("g", None)}
    assert {(r.g, r.cut): r.key for r in found.collect()} == {(g, c): ordered[g][n - 1] for g, c, n in cuts if n}


def test_a_published_split_grows_without_moving_a_row(spark):
    """Three additions; sizes are those of a new split wherever the new rows suffice, and hardly off where they do not."""
    rng = random.Random(11)
    domain = lambda k: rng.choice(["a"] * 8 + ["b"] * 3 + ["c", None])
    rows = [(k, domain(k)) for k in range(900)]
    frame = lambda rs: spark.createDataFrame(rs, "id bigint, domain string")
    published = {r.id: r.split for r in S.stratified_split(frame(rows[:300])).collect()}
    # The second addition is of one stratum only, the third brings a new stratum.
    parts = [rows[300:600], [(k, "b") for k, _ in rows[600:650]], [*rows[650:], (5000, "new"), (5001, "new"), (5002, "new")]]
    have = list(rows[:300])
    for part in parts:
        split = frame([(k, d) for k, d in have]).join(spark.createDataFrame(list(published.items()), "id bigint, split string"), "id")
        found = S.grow_split(split, frame(part).repartition(5))
        grown = {r.id: r.split for r in found.collect()}
        assert set(grown) == {k for k, _ in part}
        assert {r.id: r.split for r in S.grow_split(split, frame(part[::-1])).collect()} == grown
        have, published = have + part, {**published, **grown}
        whole = frame(have).join(spark.createDataFrame(list(published.items()), "id bigint, split string"), "id")
        drift = {(r.domain, r.split): (r.n, r.drift) for r in S.split_drift(whole).collect()}
        assert sum(n for n, _ in drift.values()) == len(have) and sum(d for _, d in drift.values()) == 0
        added = Counter(d for _, d in part)
        for d in {d for _, d in have}:
            if added[d] >= 3:  # quotas of a stratum shift by single rows when others grow
                assert all(drift[d, s][1] == 0 for s in ("train", "dev", "test"))
            assert all(abs(drift[d, s][1]) <= 2 for s in ("train", "dev", "test"))


def test_a_split_that_has_too_many_gets_none(spark):
    """All old rows are test rows: the new ones go to the others in proportion to what they lack."""
    old = spark.createDataFrame([(k, "a", "test") for k in range(50)], "id bigint, domain string, split string")
    new = spark.createDataFrame([(100 + k, "a") for k in range(30)], "id bigint, domain string")
    found = Counter(r.split for r in S.grow_split(old, new).collect())
    assert found == {"train": 20, "dev": 10}
    assert S.grow_split(old, new.limit(0)).count() == 0 and S.grow_split(old.limit(0), new).count() == 30
