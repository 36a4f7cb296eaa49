import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.llm import mixing, quality_rules, sharding, spherical

from .conftest import PROSE


def water_fill(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by repeated sharing, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > repeats * sizes[s]}
        for s in full or free:
            target[s] = Fraction(repeats * sizes[s]) if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


def corpus():
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(PROSE.split()) for _ in range(n))
    rows = [(k, words(rng.randrange(1, 60)), "big") for k in range(300)]
    rows += [(1000 + k, words(20), "a") for k in range(3)] + [(2000, words(7), "zz"), (2001, None, "zz"), (2002, words(900), None), (2003, "", "only empty")]
    return rows + rows[:2]


def test_mixing(docs_of):
    rows = corpus()
    found = mixing.mix(docs_of(rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    source = {n: s for n, _, s in rows}
    for _, text, s in rows:
        sizes[s] += len((text or "").split())
    want = water_fill(sizes)
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.time < 1 for c in r.copies) and [c.time for c in r.copies] == sorted(c.time for c in r.copies)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in sizes)
    key = lambda rs: sorted(map(repr, rs))
    assert key(mixing.mix(docs_of(rows[::-1])).collect()) == key(found)
    assert mixing.mix(docs_of([])).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 1000), min_size=1))
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want = water_fill(sizes)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-9, abs=1e-9)


def test_times_invert_the_integral(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0))):
        t = np.array([r[0] for r in df.select(mixing.time_of(F.col("u"), schedule)).collect()])
        xs = np.linspace(0, 1, 200_001)
        w = np.interp(xs, [k[0] for k in schedule], [k[1] for k in schedule])
        total = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(xs))))
        assert np.allclose(np.interp(t, xs, total / total[-1]), np.arange(101) / 100, atol=1e-6)


def test_curriculum_orders_copies_by_time(docs_of):
    docs = docs_of(corpus()[:-2])
    mixed = mixing.mix(docs)
    rows = mixing.curriculum(docs)
    assert rows.columns == docs.columns
    copies = {r.doc_id: [c.time for c in r.copies if 2 * c.words >= r.size] for r in mixed.collect()}
    order = [r.doc_id for r in rows.collect()]
    assert Counter(order) == Counter({n: len(c) for n, c in copies.items() if c})
    seen = defaultdict(int)
    times = []
    for n in order:
        times.append(copies[n][seen[n]])
        seen[n] += 1
    assert times == sorted(times)


def test_curriculum_plans_each_row_of_a_shared_id(spark):
    """Null and repeated ids: every source still gets about its target."""
    rng = random.Random(1)
    rows = [(None if k % 3 else 7, " ".join(["w"] * rng.randrange(1, 40)), ("a", "b", "c")[k % 2 + (k % 7 == 0)], "keep", k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, d string, row int").selectExpr("*", "1 AS time", "2 AS of", "3 AS copies", "4 AS none", "5 AS number")
    found = mixing.curriculum(docs)
    assert found.columns == docs.columns and found.filter("d <> 'keep' OR time <> 1").count() == 0
    words = {r.source: r.n for r in found.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    want = water_fill({s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "abc"})
    assert all(abs(words[s] - want[s]) <= 40 for s in "abc")
    assert max(r["count"] for r in found.groupBy("row").count().collect()) <= 3


def test_sharding(docs_of, odd_rows):
    rng = random.Random(3)
    rows = [(k, PROSE[: rng.randrange(1, 100)] + str(k // 2), f"s{k % 5}") for k in range(4000)] + [(5000 + k, "copy", None) for k in range(50)]
    found = sharding.shard(docs_of(rows), 16).collect()
    text = {n: t for n, t, _ in rows}
    assert len(found) == len(rows)
    total = Counter()
    for r in found:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        total[r.shard] += r.size
    assert set(total) == set(range(16))
    assert max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 16 + 2 * 102
    places, homes = defaultdict(list), defaultdict(set)
    for r in found:
        places[r.shard].append(r.slot)
        homes[text[r.doc_id]].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(h) == 1 for h in homes.values())
    odd = sharding.shard(docs_of(odd_rows), 4).collect()
    assert len(odd) == len(odd_rows) and {r.size for r in odd if r.doc_id == 1} == {1}
    assert sharding.shard(docs_of([]), 16).count() == 0
    assert len({r.shard for r in sharding.shard(docs_of([(k, "same") for k in range(9)]), 3).collect()}) == 1
    assert sharding.shards_for(1000, 300) == 4


def counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x1c#é|", max_size=80), min_size=1, max_size=12))
def test_statistics_equal_brute_force(spark, docs_of, texts):
    texts = [*texts, None, "", "a b a b a b a b a", "x " * 40]
    found = {r.doc_id: r for r in quality_rules.statistics(docs_of(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), text


def test_rules_are_learned_and_whole_tables_judged(spark, docs_of, odd_rows, no_labels):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(PROSE.split()) + str(rng.randrange(90)) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            words = [w + "%%" for w in words] if k % 8 else [w.upper() for w in words]
        rows.append((k, " ".join(words)))
        labels += [(k, 0 if bad else 1)] * (k % 3 > 0)
    labels = spark.createDataFrame([*labels, (None, 0), (9999, 0), (1, None)], "doc_id bigint, quality int")
    found = quality_rules.quality_rules(docs_of(rows), labels).collect()
    assert len(found) == len(rows) and all(r.kept == (r.doc_id % 4 != 0) for r in found)
    assert {r.rule.split()[0] for r in found if r.rule} == {"symbol_share", "upper_share"}
    plain = quality_rules.quality_rules(docs_of(odd_rows), no_labels).collect()
    assert len(plain) == len(odd_rows) and {r.kept for r in plain if r.doc_id in (1, 2, 3)} == {False}
    assert all(r.kept for r in plain if r.doc_id in (4, 5)) and [r.base_failed for r in plain if r.doc_id == 6] == [True]
    assert quality_rules.quality_rules(docs_of([]), no_labels).count() == 0


def test_no_python_on_the_main_path(spark, docs_of, no_labels):
    plan = quality_rules.statistics(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS width", "2 AS filter", "3 AS n_links")


def test_spherical_caps_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1):
        for _ in range(25):
            center = rng.normal(size=64)
            center /= np.linalg.norm(center)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((len(rows), (rng.uniform(0.5, 2) * (center + rng.normal(size=64) * 0.0155)).tolist(), label))
    names = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(linked, False)
    roots = spherical._forest(linked, np.array(names))
    assert 0 < linked.sum() < len(rows) * 10
    old, spherical.TILE = spherical.TILE, 4  # many tiles per filter
    try:
        found = {r.vec_id: r for r in spherical.near_duplicates(vectors(spark, rows)).collect()}
    finally:
        spherical.TILE = old
    links = {n: int(k) for n, k in zip(names, linked.sum(axis=1))}
    assert sum(r.n_links for r in found.values()) >= 0.99 * sum(links.values()) and all(found[n].n_links <= links[n] for n in names)
    assert sum(found[n].component_id != c for n, c in zip(names, roots.tolist())) <= 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one, two = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(1, one, 0), (2, two, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0] * 3, 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (9, [1.0, None, 3.0], 0), (2, two, 0), (None, one, 0), (10, [1.0, 2.0], 0), (11, [5.0], 0), (12, [7.0], 0), (13, [], 0)]
    found = spherical.near_duplicates(vectors(spark, rows)).collect()
    assert len(found) == len(rows)
    have = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert have[1] == (1, 1, True) and have[2] == (1, 1, False) and have[11] == (1, 11, True) and have[12] == (1, 11, False)
    assert all(have[n] == (0, n, True) for n in (3, 4, 5, 6, 7, 8, 9, 10, 13)) and have[None] == (0, None, True)
    assert spherical.near_duplicates(vectors(spark, [])).count() == 0


def test_list_decoding_finds_the_best_filters():
    rng = np.random.default_rng(0)
    x = spherical.unit(rng.normal(size=(20, 10)))
    found = spherical.decode(x)
    turn, blocks = spherical.code(10, 0)
    y = x @ turn
    parts = [y[:, a:b] @ d.T for a, b, d in blocks]
    every = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(20, -1)
    for row in range(20):
        want = np.sort(every[row])[::-1][: spherical.LISTED]
        assert np.allclose(np.sort(every[row][found[row, : spherical.LISTED]])[::-1], want)
    assert math.isclose(float(np.linalg.norm(blocks[0][2][0])), 1.0)


def at_cosine(rng, number, width, cosine):
    x, z = spherical.unit(rng.normal(size=(number, width))), rng.normal(size=(number, width))
    z = spherical.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


def test_sources_that_begin_alike_are_told_apart(spark):
    """Ranks of whole strings, not of their first bytes; null first, and in the order of their bytes."""
    sources = [None, "", "https://site0.org", "https://site0.orga", "https://site1.org", "https://é.org"]
    rows = [(k, f"text {k}", sources[k % 6], "en" if k % 2 else None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    placed = sharding.points(sharding.sized(docs)).join(sharding.sized(docs), "_text").select("source", "lang", F.shiftright("by_source", 32).alias("s"), F.shiftright("by_lang", 32).alias("l"))
    found = {(r.source, r.s) for r in placed.collect()}
    assert [x for x, _ in sorted(found, key=lambda r: r[1])] == sources and len({s for _, s in found}) == 6
    assert len({(r.lang, r.l) for r in placed.collect()}) == 2


def plain_tree(points, first, leaves):
    """Leaves of a k-d tree: split at the weighted median along the widest dimension, one list at a time."""
    if leaves == 1 or not points:
        return {p["_text"]: first for p in points}
    span = {d: max(p[d] for p in points) - min(p[d] for p in points) for d in sharding.DIMENSIONS}
    widest = max(sharding.DIMENSIONS, key=span.get)
    half, goal, held = leaves // 2, sum(p["bytes"] for p in points) * (leaves // 2) / leaves, 0
    keys = sorted({p[widest] for p in points})
    for key in keys:
        own = sum(p["bytes"] for p in points if p[widest] == key)
        if held + own >= goal or key == keys[-1]:
            cut = key if held + own - goal <= goal - held else key - 1
            break
        held += own
    return plain_tree([p for p in points if p[widest] <= cut], first, half) | plain_tree([p for p in points if p[widest] > cut], first + half, leaves - half)


def test_shards_equal_a_plain_tree(spark):
    rng = random.Random(9)
    rows = [(k, "x" * int(rng.lognormvariate(3, 1.5)) + str(k), f"https://site{rng.randrange(7)}.org", rng.choice(["en", "de", None])) for k in range(250)]
    points = sharding.points(sharding.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")))
    for shards in (2, 7, 16):
        tree = sharding.build(points, shards, tolerance=0)
        found = {r["_text"]: r["shard"] for r in points.select("_text", tree.leaf().alias("shard")).collect()}
        assert found == plain_tree([r.asDict() for r in points.collect()], 0, shards)


@pytest.mark.parametrize("width, grade", [*((w, 0) for w in range(2, 17)), (64, 0), (7, 3), (10, 5), (16, 9), (24, 4), (32, 5), (64, 1), (64, 2), (64, 5)])
def test_pairs_at_the_cosine_share_a_filter(width, grade):
    """2,000 pairs at exactly 0.98; lists of a fixed length lost 92% of them at width 3."""
    found = [[row for k in range(0, 2000, 500) for row in spherical.decode(v[k : k + 500], 0.98, grade)] for v in at_cosine(np.random.default_rng(width), 2000, width, 0.98)]
    lists = [[set(row[row >= 0].tolist()) for row in f] for f in found]
    assert all(a & b for a, b in zip(*lists, strict=True))


def test_directions_follow_the_rows(spark):
    """Unlike vectors meet about as often whatever the number of rows: directions grow with it, and lists hardly do."""
    grades = spark.createDataFrame([(1,), (1024,), (1025,), (4097,), (300_000_000,)], "n long").select(spherical.grade_of(F.col("n")).alias("g"))
    assert [r.g for r in grades.collect()] == [0, 0, 1, 2, 10]
    assert [spherical.bits_of(64, g) for g in (0, 2, 3, 10)] == [16, 20, 22, 36] and spherical.bits_of(12, 4) == 18 and spherical.bits_of(5, 9) == 16
    x = spherical.unit(np.random.default_rng(2).normal(size=(200, 64)))
    sizes = [np.mean([(row >= 0).sum() for row in spherical.decode(x, 0.98, g)]) for g in (0, 2, 4)]
    assert sizes[2] < 1.4 * sizes[0]


def test_few_and_many_vectors_of_a_filter_are_compared_alike():
    """Filters of a few vectors are compared in one go; the result is that of single comparisons."""
    rng = np.random.default_rng(6)
    x, y = at_cosine(rng, 60, 16, 0.985)
    vectors = np.concatenate((x, y, spherical.unit(rng.normal(size=(30, 16)))))
    lists = [np.sort(row[row >= 0]) for row in spherical.decode(vectors)]
    holders = {}
    for row, names in enumerate(lists):
        for name in names.tolist():
            holders.setdefault(name, []).append(row)
    groups = [(name, rows) for name, rows in sorted(holders.items()) if len(rows) > 1]
    flat = [(row, name) for name, rows in groups for row in rows]
    table = pa.table({
        "vec_id": pa.array([r for r, _ in flat], pa.int64()), "width": pa.array([16] * len(flat), pa.int32()), "filter": pa.array([n for _, n in flat], pa.int64()),
        "embedding": pa.array([vectors[r].tolist() for r, _ in flat], pa.list_(pa.float64())), "filters": pa.array([lists[r] for r, _ in flat], pa.list_(pa.int64())),
        "tile": pa.array([0] * len(flat), pa.int32()), "i": pa.array([0] * len(flat), pa.int32()), "j": pa.array([0] * len(flat), pa.int32()),
    })
    begins = np.cumsum([0, *(len(rows) for _, rows in groups)])
    want, have = [], []
    for at, (_, rows) in zip(begins.tolist(), groups, strict=False):
        found = spherical.compare(table.slice(at, len(rows)), 0.98)
        want += found.to_pylist() if found else []
    for size in {len(rows) for _, rows in groups}:
        found = spherical.compare_few(table, np.array([b for b, (_, rows) in zip(begins.tolist(), groups, strict=False) if len(rows) == size]), size, 0.98)
        have += found.to_pylist() if found else []
    key = lambda r: tuple(r.values())
    assert want and sorted(want, key=key) == sorted(have, key=key)


def test_tables_of_whole_groups_cut_no_group():
    rng = np.random.default_rng(1)
    keys = np.repeat(np.arange(60), rng.integers(1, 30, size=60))
    rows = pa.RecordBatch.from_arrays([pa.array(keys // 7), pa.array(keys)], ["a", "b"])
    batches = [rows.slice(k, 13) for k in range(0, rows.num_rows, 13)]
    found = list(spherical.whole_groups(iter(batches), ["a", "b"], 50))
    assert np.array_equal(np.concatenate([t.column("b").to_numpy() for t, _ in found]), keys) and len(found) > 5
    for table, begins in found:
        assert all(len(set(table.column("b").to_pylist()[i:j])) == 1 for i, j in zip(begins[:-1], begins[1:], strict=True))
    assert sum(len(b) - 1 for _, b in found) == 60 and list(spherical.whole_groups(iter([]), ["a"], 5)) == []


def test_decoding_lists_every_direction_above_the_threshold():
    for width in (5, 16):
        x, height = spherical.unit(np.random.default_rng(1).normal(size=(30, width))), spherical.threshold(width, 0.98)
        found = spherical.decode(x)
        turn, blocks = spherical.code(width, 0)
        parts = [(x @ turn)[:, a:b] @ d.T for a, b, d in blocks]
        every = parts[0] if len(parts) == 1 else (parts[0][:, :, None] + parts[1][:, None, :]).reshape(30, -1)
        for row in range(30):
            above = set(np.flatnonzero(every[row] / math.sqrt(len(parts)) > height).tolist())
            have = {k for k in found[row].tolist() if 0 <= k < every.shape[1]}
            assert above <= have and (have == above or len(have) == spherical.LISTED)


def test_narrow_vectors_equal_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    for width in (2, 3, 4, 5, 7, 9, 10, 12, 16):
        x, y = at_cosine(rng, 40, width, 0.9805)
        rows += [(len(rows) + k, v.tolist(), 0) for k, v in enumerate(np.concatenate((x, y)))]
    found = {r.vec_id: r.n_links for r in spherical.near_duplicates(vectors(spark, rows)).collect()}
    for width in {len(r[1]) for r in rows}:
        some = [r for r in rows if len(r[1]) == width]
        x = spherical.unit(np.array([r[1] for r in some], np.float32))
        assert [found[r[0]] for r in some] == ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()
