import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import minhash
from evalspark.llm.components import components

from .conftest import PROSE


def brute(rows, width, percent=80):
    sets = {}
    for name, text in rows:
        words = (text or "").encode().lower().split()
        sets[name] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    parent = {n: n for n in sets}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(sorted(sets), 2):
        union = sets[a] | sets[b]
        if union and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(union):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: (len(sets[n]), find(n)) for n in sets}


def variants():
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 30, 200]))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
            rows.append((len(rows), (" " if group % 2 else "\n").join(words)))
    return rows


def test_equals_brute_force(docs_of):
    rows = variants() + [(100, None), (101, ""), (102, " \t"), (103, "One Two"), (104, "one\ntwo"), (105, "ÉCOLE x"), (106, "école x")]
    for width in (4, 5):
        found = minhash.near_duplicates(docs_of(rows), width=width).collect()
        want = brute(rows, width)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_chain_across_components_is_joined(docs_of):
    # Each text is alike only to its neighbours, so the hub of a key cannot link them all.
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - k, " ".join(words[10 * k : 10 * k + 200])) for k in range(15)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows), width=4).collect()}
    assert found == {n: c for n, (_, c) in brute(rows, 4).items()} and set(found.values()) == {36}


def test_odd_rows_and_empty_tables(docs_of, odd_rows):
    found = minhash.near_duplicates(docs_of(odd_rows)).collect()
    by_id = {r.doc_id: (r.component_id, r.kept) for r in found}
    assert len(found) == len(odd_rows)
    assert by_id[5] == (4, False) and by_id[4] == (4, True) and by_id[1] == (1, True) and by_id[3] == (3, True)
    assert by_id[None] == (None, True)
    assert minhash.near_duplicates(docs_of([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=60), st.sets(st.integers(0, 2**63), min_size=1, max_size=60))
def test_parity_never_overstates_the_difference(left, right):
    a, b = (minhash.parity(np.array(sorted(s), np.uint64)).view(np.uint64) for s in (left, right))
    assert int(np.bitwise_count(a ^ b).sum()) <= len(left ^ right)


def test_pairs_within_the_distance_share_a_key(spark):
    """The pigeonhole guarantee, on signatures with exactly the largest distance."""
    rng = np.random.default_rng(3)
    data = []
    for n in range(40):
        lanes = rng.integers(0, 1 << 14, minhash.PLACES)
        other = lanes.copy()
        for k in rng.choice(minhash.PLACES, minhash.MAX_DISTANCE, replace=False):
            other[k] ^= 1 + int(rng.integers(0, (1 << 14) - 1))
        shift = np.array([15 * k for k in range(4)])
        data.append((n, *[[int(x) for x in (v.reshape(12, 4) << shift).sum(axis=1)] for v in (lanes, other)]))
    df = spark.createDataFrame(data, "n int, signature array<bigint>, other array<bigint>")
    from pyspark.sql import functions as F

    keys = df.select("n", "other", "signature", minhash._keys().alias("a")).selectExpr("n", "a", "signature AS first", "other AS signature")
    found = keys.select(F.arrays_overlap("a", minhash._keys()).alias("met"), minhash.distance(F.col("first"), F.col("signature")).alias("d")).collect()
    assert all(r.met and r.d == minhash.MAX_DISTANCE for r in found)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    links = [(1, 2), (3, 2), (2, 2), *[(10, k) for k in range(11, 40)], *chain]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, **{k: 10 for k in range(10, 40)}, **{k: 100 for k in range(100, 161)}}
    assert found == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exactly_one_row_of_each_group(spark):
    """Rows that share an id, null ids and columns with the names in use."""
    other = " ".join(f"z{k}" for k in range(30))
    rows = [(1, PROSE), (1, PROSE), (None, PROSE), (2, PROSE + " again"), (9, other), (None, other), (None, None), (None, None), (5, ""), (1, "short one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS d", "2 AS of", "3 AS number", "4 AS none", "5 AS _gone")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([(1, PROSE), (9, other), (None, None), (None, None), (5, ""), (1, "short one")], key=repr)
    plain = docs.filter("doc_id in (2, 9) or text = 'short one'")
    assert minhash.one_of_each(plain).count() == 3 and minhash.one_of_each(docs.limit(0)).count() == 0
