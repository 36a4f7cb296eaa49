"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string, rank int, score double, n int", "item_id bigint, text string, doc int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    documents, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    frequency = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        if text is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * documents) // max(1, length)
            weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency[t] + 1))) for t in own if bag[t]}
            score = sum(w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, w in weights.items())
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        for rank, (score, known, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc if known else None, -score))
    return sorted(out, key=repr)


def search(spark, docs, items, **more):
    docs = spark.createDataFrame([(d, t, 1, 2.0, 3) for d, t in docs], DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    found = ranked_search.search(docs, items, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(number, seed):
    """Texts over a skewed vocabulary; many are equal, so scores tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "日本語", "x1"]
    return [(i, " ".join(words[min(len(words) - 1, int(rng.expovariate(0.12)))] for _ in range(rng.choice([1, 2, 2, 2, 9, 40])))) for i in range(number)]


ODD = [(None, "w1 w2"), (None, "w1 w2"), (7, "W1 w2"), (7, "w1-w2"), (900, None), (901, ""), (902, " .,!\x00 \x7f"), (903, "w3 " * 50_000), (904, "É été w0")]


@pytest.mark.parametrize("more", [{}, {"postings_in_shard": 40}, {"item_bytes": 30}, {"postings_in_shard": 300, "k": 1}, {"k": 1000}])
def test_equals_scoring_every_document(spark, more):
    docs = made(400, 1) + ODD
    items = [(1, "w0 w5"), (2, "W40, w41; w0"), (3, None), (4, ""), (5, "nowhere"), (None, "w2"), (6, "w1 w2 w3"), (6, "w30"), (8, " ".join(f"w{i}" for i in range(60))), (9, "日本語 É é")]
    assert search(spark, docs, items, **more) == plain(docs, items, more.get("k", 10))


def test_terms_are_runs_of_bytes_beyond_ascii_too():
    text = "Ab-C\x00d_E é\x80日本 x y İ" + "".join(map(chr, range(128)))
    assert [t.decode() for t in ranked_search.terms(text)] == terms(text)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_sides(spark, docs, items):
    assert search(spark, docs, items) == plain(docs, items, 10)


def test_all_documents_equal(spark):
    """A term that all have may weigh nothing; equal scores go to the least ids."""
    docs = [(i, "same text") for i in range(2000, 0, -1)] + [(0, "other")]
    items = [(1, "same"), (2, "other same")]
    assert search(spark, docs, items) == plain(docs, items, 10)


def shard_of(rows):
    """A shard from {term: impact} of each document."""
    flat = [(d, t, v) for d, row in enumerate(rows) for t, v in sorted(row.items())]
    owners, numbers, impact = (np.array(c, np.int64) for c in zip(*flat, strict=True))
    return ranked_search.Shard(owners, numbers, impact, len(rows), int(numbers.max()))


def test_stops_before_the_lists_end_and_only_strictly_below():
    rng = random.Random(3)
    rows = [{t: rng.randrange(1, 1000) for t in (1, 2, 3)} for _ in range(5000)]
    for d in range(20):
        rows[d] = {1: 1500 + d, 2: 1500, 3: 1500}
    shard, numbers, weights = shard_of(rows), np.array([1, 2, 3]), np.array([3, 2, 1])
    found, scores, looked = shard.best(numbers, weights, 10, 1)
    assert sorted(found.tolist()) == list(range(10, 20)) and looked < 100
    # With all impacts equal no bound lies strictly below the k-th score, so every document is looked up and returned.
    found, _, looked = shard_of([{1: 5}] * 300).best(np.array([1]), np.array([1]), 10, 1)
    assert looked == 300 and len(found) == 300


def test_looked_up_places_move_the_best_position():
    """Documents read from one list are seen in the other, whose bound falls further than what was read there."""
    n = 400
    rows = [{1: 10_000 - d, 2: 10_000 - d} if d < n else {2: 1} for d in range(2 * n)]
    shard = shard_of(rows)
    found, _, looked = shard.best(np.array([1, 2]), np.array([1, 1]), 16, 1)
    assert sorted(found.tolist()) == list(range(16))
    assert looked <= 32 + 16
