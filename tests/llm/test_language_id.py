"""Language filters against plain counting, and accuracy on texts that were not learned from."""

import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import language_id as L
from evalspark.llm.queries import QUERIES

ROWS = "text string, lang string, score int, place int, gram int, n int"
SYLLABLES = {"en": "the ing and tion her", "de": "der sch ein ung ich", "xx": "kwa zol mip tuq vex", "日": "日本 語の 文字 です ます"}


def text_of(rng, lang, number):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(number))


def rows_of(spark, rows):
    return spark.createDataFrame([(t, x, 1, 2, 3, 4) for t, x in rows], ROWS).repartition(3)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(5)
    rows = [(text_of(rng, lang, 60), lang) for lang, times in (("en", 60), ("de", 20), ("xx", 10), ("日", 10)) for _ in range(times)]
    # German pages with an English line, rows without a language, without a text, and repeated ones.
    rows += [(text_of(rng, "de", 40) + " " + text_of(rng, "en", 4), "de") for _ in range(20)]
    return [*rows, *rows[:5], (text_of(rng, "xx", 50), None), (None, "en"), ("", "de"), ("12 34 _ ² Ⅷ", "en"), ("ǅ m² don't A1B " + "x" * 700, "en")]


def grams_of(text):
    """N-grams as texts, from the definition."""
    padded = [" " + "".join(run) + " " for ok, run in itertools.groupby((text or "").lower(), str.isalpha) if ok]
    return [p[k : k + n] for p in padded for n in L.ORDERS for k in range(len(p) - n + 1)]


def hashed(gram):
    """The hash of an n-gram, as it stands in a text of its own."""
    places, hashes = list(L.n_grams(f".{gram.strip()}."))[len(gram) - 2]
    return int(hashes[places.tolist().index(0 if gram[0] == " " else 1)])


def plain_grams(rows):
    counts = Counter()
    for text, lang in rows:
        if lang is not None:
            counts.update((lang, g) for g in grams_of(text))
    return counts


def test_n_grams_are_those_of_padded_words(monkeypatch):
    assert L.words("m²x-y_z1é") == ["m", "x", "y", "z", "é"] and L.words("12²Ⅷ_") == []
    texts = ["ab-c", "", "x", "Ä日本 ½ ² don't", " \n\t", "ǅ" * 9, "long" * 50, "é1é"]
    lines, begins = L.joined(texts)
    assert lines == "\n" + "".join(t.lower() + "\n" for t in texts)
    first = None
    for size in (500_000, 7, 64):
        monkeypatch.setattr(L, "CHARACTERS", size)
        found = sorted((int(p), int(h)) for places, hashes in L.n_grams(lines) for p, h in zip(places, hashes, strict=True))
        first = first or found
        assert found == first  # however the text is cut
    owner = Counter(int(np.searchsorted(begins, p, side="right")) - 1 for p, _ in found)
    assert [owner[k] for k in range(len(texts))] == [len(grams_of(t)) for t in texts]
    assert len({hashed(g) for t in texts for g in grams_of(t)}) == len({g for t in texts for g in grams_of(t)})


def test_counts_equal_plain_ones(spark, labelled):
    found = L.gram_counts(L.word_counts(rows_of(spark, labelled))).collect()
    want = {(lang, hashed(g)): n for (lang, g), n in plain_grams(labelled).items()}
    assert {(r["lang"], r["gram"] % 2**64): r["n"] for r in found} == want


def plain_members(rows):
    counts, totals = plain_grams(rows), Counter()
    for (lang, _), n in counts.items():
        totals[lang] += n
    rates = {key: n / totals[key[0]] for key, n in counts.items()}
    top = Counter()
    for (_, g), rate in rates.items():
        top[g] = max(top[g], rate)
    return {key for key, rate in rates.items() if rate >= L.MIN_RATE and rate >= L.CONTRAST * top[key[1]]}


def held(filters, hashes):
    """Bitmasks of the languages that contain n-grams."""
    row = filters.cells[0]
    return np.bitwise_and.reduce([row[L._cell(*L._halves(hashes), turn, len(row))] for turn in range(L.HASHES)])


def test_filters_hold_every_member_and_few_others(spark, labelled):
    members = plain_members(labelled)
    filters = L.learn(spark, rows_of(spark, labelled))
    assert filters.languages == ["de", "en", "xx", "日"] and filters.preferred[0] == 1
    grams = sorted({g for _, g in members})
    masks = held(filters, np.array([hashed(g) for g in grams], np.uint64))
    extra = 0
    for g, mask in zip(grams, masks.tolist(), strict=True):
        own = {k for k, lang in enumerate(filters.languages) if (lang, g) in members}
        have = {k for k in range(4) if mask >> k & 1}
        assert own <= have
        extra += len(have - own)
    assert extra <= 0.02 * len(grams)
    # The rate of false positives is what n-grams that nobody has show.
    shown = held(filters, np.random.default_rng(1).integers(0, 2**64, 200_000, np.uint64))
    for k, chance in enumerate(filters.chance()):
        assert abs((shown >> np.uint64(k) & np.uint64(1)).mean() - chance) < 0.2 * chance + 1e-4


def test_counts_are_corrected_for_chance():
    filters = L.Filters(["a", "b"], [0, 1], np.zeros((1, 16), np.uint64))
    hits, chance = np.array([[50, 45, 100], [0, 0, 0], [3, 3, 3]]), np.array([0.4, 0.01])
    best, score = filters.decide(hits, chance)
    assert best.tolist() == [1, -1, 0] and score[0] == pytest.approx((45 - 1) / 0.99 / 100) and score[1] == 0


def test_predictions_and_edge_cases(spark, labelled):
    rng = random.Random(9)
    filters = L.learn(spark, rows_of(spark, labelled))
    texts = [(k, text_of(rng, lang, 30), lang) for k, lang in enumerate(list(SYLLABLES) * 20)]
    odd = [(100, None, "und"), (101, "", "und"), (102, " 12 !? ² _", "und"), (103, "日本語の" * 30_000, "日"), (103, "日本語の" * 30_000, "日"), (None, "ing " * 50_000 + "ung", "en")]
    docs = spark.createDataFrame([(k, t, "?", 1.0) for k, t, _ in texts + odd], "doc_id long, body string, lang_pred string, score double")
    found = filters.predict(docs, ["doc_id"], "body").collect()
    have = sorted(((r["doc_id"], r["lang_pred"]) for r in found), key=repr)
    assert have == sorted(((k, lang) for k, _, lang in texts + odd), key=repr)
    assert all(0 <= r["score"] <= 1 for r in found) and {r["score"] for r in found if r["lang_pred"] == "und"} == {0.0}
    # A text of unknown letters is a learned language still.
    assert filters.predict(spark.createDataFrame([(1, "ωωω")], "doc_id long, text string"), ["doc_id"]).first()["lang_pred"] in filters.languages


def test_nothing_learned_and_empty_tables(spark):
    for rows in ([], [(None, "en")], [("a b", None)]):
        filters = L.learn(spark, rows_of(spark, rows))
        assert filters.predict(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ["doc_id"]).first()["lang_pred"] == "und"
    filters = L.learn(spark, rows_of(spark, [("a b", "en")]))
    assert filters.predict(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_more_than_64_languages(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": [a + b for a, b in zip(rng.choices(letters, k=6), rng.choices(letters, k=6), strict=True)] for k in range(70)}
    make = lambda lang: " ".join("".join(rng.choices(own[lang], k=3)) for _ in range(80))
    filters = L.learn(spark, rows_of(spark, [(make(lang), lang) for lang in own]))
    assert filters.cells.shape[0] == 2
    docs = spark.createDataFrame([(lang, make(lang)) for lang in own], "lang string, text string")
    found = filters.predict(docs, ["lang"])
    assert found.filter(F.col("lang") == F.col("lang_pred")).count() >= 67


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the test tables are not here")
def test_accuracy_on_texts_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op11_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert held["n"] > 200 and held["right"] >= 0.98
