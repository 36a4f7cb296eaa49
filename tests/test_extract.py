import random

from evalspark.operators import extract as X

RESPONSE = """Some thoughts.
--- CANDIDATE ---
plan_id: add_len
rationale: shorter answers
are better
<PROMPT>
Line one.
Line two.
</PROMPT>
--- CANDIDATE ---
plan_id: no_body
rationale: nothing
--- CANDIDATE ---
rationale: no plan given
<PROMPT>Only this.</PROMPT>
"""


def test_candidates(spark):
    rows = X.extract_candidates(spark.createDataFrame([(1, RESPONSE), (2, "none")], "doc_id int, text string")).orderBy("position").collect()
    assert [(r.position, r.plan_id, r.rationale, r.artifact) for r in rows] == [
        (1, "add_len", "shorter answers\nare better", "Line one.\nLine two."),
        (3, "unknown", "no plan given", "Only this."),
    ]


def test_selections(spark):
    texts = [
        'I choose "iter=27" because: it is best\nreally', "merge=25,27", "merge=25, 27 Reason: both", "merge=1,2 or iter=3", "no idea",
    ]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)] + [("new", 9, "no idea")], "run_id string, n int, text string")
    best = spark.createDataFrame([("r", 7)], "run_id string, iter bigint")
    found = {r.n: (r.action, r.iters, r.rationale) for r in X.parse_selection(df, best).collect()}
    assert found == {
        0: ("iter=27", [27], "it is best"), 1: ("merge=25,27", [25, 27], "Default selection"), 2: ("merge=25,27", [25, 27], "both"),
        3: ("iter=3", [3], "Default selection"), 4: ("iter=7", [7], "Default selection"), 9: ("iter=0", [0], "Default selection"),
    }


def test_merge(spark):
    text = "--- MERGE ---\nrationale: first from 1,\nsecond from 2\n<PROMPT>\n\nAll.\n\n</PROMPT>"
    row = X.parse_merge(spark.createDataFrame([(1, text)], "n int, text string")).first()
    assert (row.rationale, row.artifact) == ("first from 1,\nsecond from 2", "All.")


def constraints(spark, text, strict=True):
    df = X.user_constraints(spark.createDataFrame([(1, text)], "n int, text string"), strict=strict)
    return [r.constraint for r in df.orderBy("position").collect()]


def test_user_constraints(spark):
    two = "# Title\n## USER\n\nNo length edits.\n\n## OBSERVATION\n\nFine.\n\n## USER\n\nBe clear.\n"
    assert constraints(spark, two) == ["No length edits.", "Be clear."] == constraints(spark, two, strict=False)
    assert constraints(spark, "## NOTE\nnothing") == []
    odd = "## USER\nkeep\n### detail\nthis\n## USERS\nother\n## USER\n \n\n## USER"
    assert constraints(spark, odd) == ["keep\n### detail\nthis"]
    assert constraints(spark, odd, strict=False) == ["keep", "other", ""]
    assert constraints(spark, "a ## USER\nno heading") == []
    assert constraints(spark, "## USER\nat the start") == ["at the start"]


def test_notes_summary(spark):
    long = "## USER\nbe kind\n## LOG\n" + "x" * 1990 + "y" * 1000
    data = [(1, "## USER\nbe kind"), (2, " \n"), (3, long)]
    found = {r.n: r.summary for r in X.notes_summary(spark.createDataFrame(data, "n int, text string")).collect()}
    assert found[1] == "=== NOTEBOOK ===\n\n### User Constraints\n1. be kind\n\n### Full Content\n## USER\nbe kind"
    assert found[2] == "No notebook content."
    assert found[3].endswith("### Recent Content (last 1000 chars)\n" + "y" * 1000)


def test_constraint_filter(spark):
    data = [("r", 1, "add_length", "Make it Longer, please"), ("r", 2, "tone", "kinder words"), ("r", 3, "x", "a long one"), ("r", 4, "length-limit", "")]
    kind = "run_id string, candidate_id int, plan_id string, rationale string"
    candidates = spark.createDataFrame(data, kind)
    kept = lambda *t: sorted(r.candidate_id for r in X.constraint_filter(candidates, spark.createDataFrame([(x,) for x in t], "term string")).collect())
    assert kept("longer please") == [2, 3, 4]
    assert kept("LONGER, please!", "length limit") == [2, 3]
    assert kept("long") == [1, 2, 4]
    assert kept("...") == [1, 2, 3, 4]


def test_constraint_filter_keeps_runs_apart(spark):
    candidates = spark.createDataFrame([("r1", 1, "p", "be loud"), ("r2", 1, "p", "be calm")], "run_id string, candidate_id int, plan_id string, rationale string")
    found = lambda terms: sorted(r.run_id for r in X.constraint_filter(candidates, spark.createDataFrame(terms, "run_id string, term string")).collect())
    assert found([(None, "loud")]) == ["r2"]
    assert found([("r1", "be")]) == ["r2"]
    assert found([("r2", "loud")]) == ["r1", "r2"]


def test_a_huge_iteration_drops_out(spark):
    texts = spark.createDataFrame([("r", 1, "merge=1,99999999999999999999"), ("r", 2, "merge=1,2")], "run_id string, n int, text string")
    best = spark.createDataFrame([("r", 5)], "run_id string, iter bigint")
    assert {r.n: r.iters for r in X.parse_selection(texts, best).collect()} == {1: [1], 2: [1, 2]}


def test_repeats(spark):
    from evalspark.functions.hashing import sha16

    log = spark.createDataFrame([("r", 5, 2, "p", "old")], "run_id string, iter bigint, parent bigint, plan_id string, artifact string")
    log = log.withColumn("artifact_hash", sha16("artifact"))
    new = spark.createDataFrame(
        [("r", 9, "q", "old"), ("r", 2, "p", "new"), ("r", 3, "p", "new"), ("s", 2, "p", "old")],
        "run_id string, parent bigint, plan_id string, artifact string",
    )
    found = {(r.parent, r.same_text, r.same_plan) for r in X.repeat_proposals(new, log).collect()}
    assert found == {(9, True, False), (2, False, True)}


def plain_mentions(texts, terms):
    spoken = {k: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for k, t in texts.items()}
    wanted = [[w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for t in terms]
    return {k for k, ws in spoken.items() if any(t and ws[i : i + len(t)] == t for t in wanted for i in range(len(ws)))}


def test_terms_of_any_length_walk_the_prefix_tree(spark):
    """Terms that begin alike, hold each other, repeat, or are longer than the text; against a plain search."""
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for k in range(120)}
    texts[500] = " ".join(f"w{i}" for i in range(400))
    terms = [" ".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 5, 6, 7, 8)]
    terms += ["A B-C a b c a", "a b c a b", "...", "", " ".join(f"w{i}" for i in range(5, 300)), " ".join(f"w{i}" for i in range(5, 299)) + " x"]
    candidates = spark.createDataFrame([("r", k, "", t) for k, t in texts.items()], "run_id string, candidate_id int, plan_id string, rationale string")
    for some in (terms, terms[:1], terms[8:9], []):
        kept = X.constraint_filter(candidates, spark.createDataFrame([(t,) for t in some], "term string"))
        assert {r.candidate_id for r in kept.collect()} == set(texts) - plain_mentions(texts, some)


def test_only_living_prefixes_go_on(spark, monkeypatch):
    """Two terms of six words and texts of 200 words that rarely begin one: few rows, where every word sequence would be 200 each."""
    rng = random.Random(5)
    rows = [("r", k, "", " ".join(rng.choice(["one", "two", "x", "y", "z"]) for _ in range(200))) for k in range(40)]
    candidates = spark.createDataFrame(rows, "run_id string, candidate_id int, plan_id string, rationale string")
    living = []
    settle = X.settle
    monkeypatch.setattr(X, "settle", lambda df, name: (lambda out: living.append(out.count()) or out if name == "living-prefixes" else out)(settle(df, name)))
    X.constraint_filter(candidates, spark.createDataFrame([("one two one two one two",), ("one two one two x x",)], "term string")).count()
    assert len(living) == 6 and living == sorted(living, reverse=True)
    assert sum(living) < 40 * 200 / 3 and living[-1] < 20
