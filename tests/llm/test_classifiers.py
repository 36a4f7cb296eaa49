import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from evalspark.llm import cotraining, linear, toxicity

from .conftest import PROSE

BAD = ("grumble", "snarlish", "vexword")


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    """Documents with bad words or junk in them, and labels for two thirds."""
    rng = random.Random(2)
    rows, toxic, junk, labels = [], {}, {}, []
    for k in range(900):
        words = [rng.choice(PROSE.split()) + str(rng.randrange(60)) for _ in range(rng.randrange(20, 90))]
        toxic[k], junk[k] = k % 5 == 0, k % 7 == 0
        if toxic[k]:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if junk[k]:
            words = [w + "%%%" for w in words]
        rows.append((k, " ".join(words), f"s{k % 3}"))
        if k % 3:
            labels.append((k, int(not junk[k]), int(toxic[k])))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    return docs_of(rows), labels, toxic, junk


def test_toxicity(corpus, docs_of, odd_rows, no_labels):
    docs, labels, toxic, _ = corpus
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == 900 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out]
    assert 150 < len(held) < 300 and np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    odd = toxicity.score_toxicity(docs_of(odd_rows), no_labels).collect()
    assert len(odd) == len(odd_rows) and all(r.predicted == 0 for r in odd)
    assert toxicity.score_toxicity(docs_of([]), labels).count() == 0


def test_the_held_out_fold_is_not_learned_from(corpus):
    docs, labels, _, _ = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(linear.fold() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rs: sorted((r.doc_id, r.score) for r in rs)
    assert key(toxicity.score_toxicity(docs, labels).collect()) == key(toxicity.score_toxicity(docs, flipped).collect())


def test_the_negative_risk_is_bounded():
    """On data without signal the plain unbiased risk drives the positives' loss down without end."""
    rng = np.random.default_rng(0)
    rows = lambda n: linear.Rows.of([np.sort(rng.choice(300, 20, replace=False)).astype(np.int32) for _ in range(n)], [np.full(20, 0.2, np.float32)] * n)
    positive, unlabelled = rows(40), rows(200)
    weights = toxicity.fit_nnpu(positive, lambda w: toxicity.sums_of(unlabelled, w), 0.3, steps=400, rate=0.05)
    at = [r.logits(weights[:-1]) + weights[-1] for r in (positive, unlabelled)]
    negative = np.logaddexp(0, at[1]).mean() - 0.3 * np.logaddexp(0, at[0]).mean()
    assert negative > -0.05


def test_sums_over_a_table_equal_plain_ones(spark):
    """Loss and gradient of the unlabelled rows, added up by tasks, against one loop per row."""
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(50, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(300)]
    values = [rng.random(len(x)).astype(np.float32) for x in lists]
    table = spark.createDataFrame([(x.tolist(), v.tolist()) for x, v in zip(lists, values, strict=True)], "ids array<int>, values array<float>").repartition(7)
    weights = np.zeros((1 << linear.BITS) + 1)
    weights[:50], weights[-1] = rng.normal(size=50), -0.4
    loss, gradient = 0.0, np.zeros_like(weights)
    for x, v in [*zip(lists, values, strict=True), *[(np.zeros(0, int), np.zeros(0))] * 45]:
        z = float(weights[x] @ v) + weights[-1]
        loss += np.log1p(np.exp(z))
        gradient[x] += v / (1 + np.exp(-z))
        gradient[-1] += 1 / (1 + np.exp(-z))
    found = toxicity.distributed(table, 345)(weights)
    assert found.rows == 345 and found.loss == pytest.approx(loss) and np.allclose(found.gradient, gradient)


def plain_words(text):
    """Features as texts: the word and its beginnings."""
    words = [t.strip(toxicity._EDGE) for t in text.lower().split()]
    return [(k, w[:k] if k else w) for w in words if w for k in (0, 3, 4, 5) if k == 0 or len(w) > k]


def test_words_of_whole_texts_are_hashed_alike(monkeypatch):
    texts = ["", " \n", "Brook, brooks! (BROOK) ... a-b", "日本語の文字です «naïveté» ﬁx", "x" * 300 + " don't \x1f y\u2003z", "abcde abcdef abcd", "brook"]
    names = {}
    for size in (500_000, 20, 7):
        monkeypatch.setattr(toxicity, "CHARACTERS", size)
        some = texts if size > 20 else [t for t in texts if len(t) < 300]
        rows, ids, sizes = toxicity.Words().features(some)
        assert sizes.tolist() == [len(t.split()) for t in some]
        for k, text in enumerate(some):
            own = Counter(plain_words(text))
            have = Counter(ids[rows == k].tolist())
            assert sorted(have.values()) == sorted(own.values())
            names.setdefault(text, have)
            assert names[text] == have  # however the texts are cut
    monkeypatch.undo()
    assert names["brook"].keys() <= names[texts[2]].keys()
    lists, values = toxicity.Words().rows(texts)
    assert [len(x) for x in lists] == [len(set(plain_words(t))) for t in texts]
    weights = np.random.default_rng(1).normal(size=1 << linear.BITS)
    want = [float(weights[i] @ v) if len(i) else 0.0 for i, v in zip(lists, values, strict=True)]
    assert np.allclose(toxicity.Words().scores(texts, weights), want, atol=1e-5)


def test_scores_sum_the_weights_of_all_features():
    words = ["", "...", "a", "abc", "Abcd.", "«naïveté»", "日本語の文字", "ﬁx", "x" * 300, "don't", "(abcde)"]
    view, weights = cotraining.content_view(), np.random.default_rng(1).normal(size=1 << linear.BITS)
    texts = ["a a b", "", "One two, two %% %% x", " \n", " ".join(words)]
    want = []
    for text in texts:
        tokens = text.split()
        total = sum(weights[linear.bucket(f)] for t in tokens for f in cotraining.content_features(t))
        total += weights[linear.bucket("=previous")] * sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        want.append(total / np.sqrt(max(1, len(tokens))))
    assert np.allclose(view.scores(texts, weights), want)


def test_features_are_counted_over_all_rows(spark, docs_of, odd_rows):
    rows = [*odd_rows, (50, "brook brook brooks"), (51, "Brook!")]
    found = linear.frequencies(docs_of(rows), toxicity.Words)
    want = np.zeros_like(found)
    for _, text in rows:
        want[toxicity.Words().rows([text or ""])[0][0]] += 1
    brook, brooks = (toxicity.Words().features([t])[1] for t in ("brook", "brooks"))
    assert (found == want).all() and found[brook[0]] == 2
    wanted = np.zeros(1 << linear.BITS, bool)
    wanted[[brook[0], brooks[3]]] = True  # the word, and the first five letters of longer ones
    kept = {len(r.ids): dict(zip(r.ids, r.values, strict=True)) for r in linear.reduced_rows(docs_of(rows), toxicity.Words, wanted).collect()}
    assert kept == {1: {brook[0]: 1.0}, 2: {brook[0]: pytest.approx(2 / 3**0.5), brooks[3]: pytest.approx(1 / 3**0.5)}}


def test_a_rare_word_that_only_the_whole_corpus_proves_is_used(spark, docs_of):
    """One in 400 documents has the toxic word. Few positives have it, too, but hardly any other text; and a word that is as
    common in the whole corpus as among the positives is left out."""
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(6000):
        words = [rng.choice(PROSE.split()) for _ in range(12)]
        toxic = k % 60 == 1
        if toxic:
            words.append("vexword" if k % 600 < 90 else "grumble")
        if k % 3 == 0 or toxic:
            words.append("common")
        rows.append((k, " ".join(words)))
        if toxic or k % 40 == 0:
            marks.append((k, int(toxic)))
    docs, labels = docs_of(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    toxic = {k for k in found if k % 60 == 1}
    assert np.mean([found[k] for k in toxic]) > 0.9 and np.mean([found[k] for k in found if k not in toxic]) < 0.02


def test_quality(corpus, docs_of, odd_rows, no_labels):
    docs, labels, _, junk = corpus
    found = cotraining.score_quality(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 900 and np.mean([r.kept != junk[r.doc_id] for r in held]) > 0.97
    odd = cotraining.score_quality(docs_of(odd_rows), no_labels).collect()
    assert len(odd) == len(odd_rows) and all(r.kept for r in odd)
    assert cotraining.score_quality(docs_of([]), labels).count() == 0


def test_views_teach_each_other():
    """Both views can tell the classes, by 40 words each, but the labels show only a few of the words."""
    gains = []
    for seed in range(6):
        rng = np.random.default_rng(seed)

        def view(truth, rng=rng):
            ids = [np.sort(40 * y + rng.choice(40, 2, replace=False)).astype(np.int32) for y in truth]
            return linear.Rows.of(ids, [np.ones(len(i), np.float32) for i in ids])

        labels, pool, test = np.array([0, 1] * 4), rng.integers(0, 2, 600), rng.integers(0, 2, 400)
        first, second = ([view(t) for t in (labels, pool, test)] for _ in range(2))
        weights = cotraining.cotrain([first[0], second[0]], labels, [first[1], second[1]])
        alone = linear.fit_logistic(second[0], labels)
        right = [np.mean((second[2].logits(w[:-1]) + w[-1] > 0) == test) for w in (alone, weights[1])]
        gains.append(right[1] - right[0])
    assert np.mean(gains) > 0.1


def test_calibration_gives_frequencies():
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000)
    labels = (rng.random(4000) < linear.sigmoid(2 * z - 1)).astype(int)
    slope, offset = linear.calibrate(3 * z[:, None], labels)
    assert slope == pytest.approx(2 / 3, abs=0.08) and offset == pytest.approx(-1, abs=0.15)


def test_pipeline_stages_work_on_what_is_left(spark, corpus, tmp_path):
    docs, labels, toxic, junk = corpus
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    twins = plain.filter("doc_id % 10 = 1").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s0", 0)], plain.schema)
    folder = str(tmp_path)
    plain.unionByName(twins).unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    left, counts = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, folder)
        if k < 4:
            assert out.columns == plain.columns
        out.write.parquet(f"{folder}/{k}")
        left = spark.read.parquet(f"{folder}/{k}")
        counts[name] = {r.doc_id for r in left.select("doc_id").collect()}
    after_toxic, after_quality, after_dedup, after_mix, last = counts.values()
    base = set(range(900)) | {k + 5000 for k in range(900) if k % 10 == 1}
    wrong = {k for k in base if (k in after_toxic) == toxic[k % 5000]}
    assert len(wrong) < 0.03 * len(base)
    assert sum((k in after_quality) == junk[k % 5000] for k in after_toxic & base) < 0.03 * len(base)
    assert not {k for k in after_dedup if k >= 5000 and k < 9000 and k - 5000 in after_dedup}
    assert {k % 5000 for k in after_quality & base} == {k % 5000 for k in after_dedup & base}
    assert after_mix <= after_dedup and last == after_mix and left.filter("NOT round_trip").count() == 0
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, run.select("doc_id", "n_tokens").collect())) == sorted(map(repr, left.select("doc_id", "n_tokens").collect()))


def test_words_that_only_the_pool_holds_are_learned(spark, docs_of):
    """The source tells the classes of all documents to learn from; the labelled ones have other words than the pool."""
    rng, rows, labels, ask = random.Random(5), [], [], {}
    for k in range(1200):
        bad, labelled = k % 3 == 0, k % 4 == 1
        signs = ("grumble", "snarlish") if labelled and bad else ("brook", "meadow") if labelled else BAD[2:] if bad else ("harbour",)
        words = [rng.choice(PROSE.split()) for _ in range(30)]
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(signs))
        asked = k >= 1000
        rows.append((k, " ".join(words), f"new{k}" if asked else "dump" if bad else "library"))
        if asked and not labelled:
            ask[k] = bad
        elif not asked and labelled:
            labels.append((k, int(not bad)))
    docs = docs_of(rows)
    model = cotraining.learn(docs.filter("doc_id < 1000"), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    found = docs.select("doc_id", cotraining.score_column(docs, model).alias("score")).collect()
    bad, good = ([r.score for r in found if ask.get(r.doc_id) is kind] for kind in (True, False))
    # Without the pool's words the two are told apart no better than by chance (0.5).
    assert np.mean([b < g for b in bad for g in good]) > 0.8


def test_few_labels_give_no_constant(corpus, spark):
    docs, labels, _, junk = corpus
    found = cotraining.score_quality(docs, labels.filter("doc_id < 60 AND quality IS NOT NULL")).collect()
    assert np.mean([r.kept != junk[r.doc_id] for r in found]) > 0.9 and len({r.score for r in found}) > 100
