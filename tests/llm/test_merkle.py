"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from evalspark.llm import common, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, arity):
    """The root, and the siblings' hashes of each node level by level, left to right."""
    paths, spots, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for row, spot in enumerate(spots):
            run, slot = runs[spot // arity], spot % arity
            paths[row].append((slot, run[:slot] + run[slot + 1 :]))
            spots[row] = spot // arity
        level = [h(*run) for run in runs]
    return (level[0] if level else None), paths


def fold(leaf, path):
    for slot, others in path:
        leaf = h(*others[:slot], leaf, *others[slot:])
    return leaf


def plain(rows, arity, altered):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf, other = (h(*map(written, (doc_id, source, lang, n, text))) for n in (n_chars, altered(doc_id, n_chars)))
        groups.setdefault(lang, []).append((doc_id, leaf, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climb([r[1] for r in groups[n]], arity) for n in names]
    root, tops = climb([t[0] for t in trees], arity)
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (doc_id, leaf, other), path in zip(groups[name], paths, strict=True):
            folded = fold(fold(other, path), top)
            out.append((doc_id, leaf, subroot, root, h(*[x for _, others in path + top for x in others]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 % 101, f"text {i} é日本", ("en", "de", "fr")[min(2, i % 5)], f"s{i % 3}", i) for i in range(101)]
    found += [(500, None, None, None, None), (501, "", "", "", 0), (7, "twice", "en", "s", 3), (7, "twice", "en", "s", 3), (None, "no id", "en", "s", 5)]
    return [*found, (14, None, "ÿ", "s", None), (21, "x" * 200_000, "zz", "s", 9), (2**62, "big id", "zz", "s", -4), (28, "1:a", "1", "2:-", 2**63 - 1)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_a_plain_tree(spark, rows, arity):
    def altered(doc_id, n_chars):
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        return n_chars + 1 if hit and n_chars < 2**63 - 1 else n_chars

    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS i", "2 AS g", "'x' AS hash", "3 AS _order", "4 AS _spread", "5 AS n")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & (F.col("n_chars") < 2**63 - 1)
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, altered={"n_chars": changed}, arity=arity)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    have = sorted((tuple(r) for r in found.collect()), key=repr)
    assert have == plain(rows, arity, altered)
    assert {r[-1] for r in have} == {True, False}


@pytest.mark.parametrize("number", [0, 1, 2])
def test_few_rows(spark, rows, number):
    docs = spark.createDataFrame(rows[:number], DOCS)
    have = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert have == plain(rows[:number], 2, lambda _, n: n)


def test_one_group_of_repeated_rows_is_dealt_out(spark):
    """Rows that are equal in everything do not fill one partition."""
    docs = spark.createDataFrame([(1, "same", "en", "s", 4)], DOCS).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(4000)))).repartition(4)
    numbers = common.numbered(docs.select("lang", "doc_id"), ["lang"], ["doc_id"], "i", "n")
    assert sorted(r.i for r in numbers.select("i").collect()) == list(range(4000))
    ranged = docs.select("lang", "doc_id").withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(8, "lang", "doc_id", "_spread")
    sizes = ranged.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 4000
    root, _ = climb([h(*map(written, (1, "s", "en", 4, "same")))] * 4000, 2)
    assert {r.root for r in merkle.manifest(docs).select("root").collect()} == {root}


def test_every_row_fails_after_a_change_of_the_root(spark, rows):
    """A changed field changes the root, so a manifest of other data has another root."""
    docs = spark.createDataFrame(rows, DOCS)
    one = merkle.manifest(docs).first()["root"]
    other = merkle.manifest(docs.withColumn("source", F.when(F.col("doc_id") == 501, "s").otherwise(F.col("source")))).first()["root"]
    assert one != other
