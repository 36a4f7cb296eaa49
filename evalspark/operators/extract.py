"""Structure from texts: candidates, selections, merges, user constraints.

Everything is row-local (no shuffle), except the look-ups against the log and the banned terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.hashing import sha16
from evalspark.functions.text import find, plan_of, prompt_of, rationale_of, strip, user_sections, words
from evalspark.operators.keys import join_on
from evalspark.plans.shared import settle


def extract_candidates(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate block that has an artifact text."""
    others = [c for c in responses.columns if c != text]
    parts = F.split(F.col(text), fixed.CANDIDATE_DELIMITER)
    blocks = responses.select(*others, F.posexplode(parts).alias("position", "_part")).where(F.col("position") > 0)
    part = F.col("_part")
    return blocks.select(
        *others, F.col("position").cast("bigint").alias("position"),
        plan_of(part).alias("plan_id"), rationale_of(part).alias("rationale"), prompt_of(part).alias("artifact"),
    ).where(F.col("artifact") != "")


def parse_selection(selections: DataFrame, best: DataFrame, text: str = "text") -> DataFrame:
    """The action a selection text asks for: one iteration, a merge, or the run's best by default.

    ``best`` has one row per run (``run_id, iter``). An iteration wins over a merge. Iterations too
    large for a bigint are in no log and drop out of ``iters``.
    """
    others = [c for c in selections.columns if c != text]
    defaults = best.select("run_id", F.col("iter").alias("_best"))
    single = F.regexp_extract(text, fixed.SELECT_ITER_PATTERN, 1)
    merged = F.regexp_replace(F.regexp_extract(text, fixed.SELECT_MERGE_PATTERN, 1), r"\s", "")
    reason = find(F.col(text), fixed.SELECT_RATIONALE_PATTERN)
    named = (
        F.when(single != "", F.array(single)).when(merged != "", F.split(merged, ","))
        .otherwise(F.array(F.coalesce(F.col("_best"), F.lit(0)).cast("string")))
    )
    kind = F.when(single != "", "iter").when(merged != "", "merge").otherwise("iter")
    return (
        join_on(selections, defaults, ["run_id"], "left")
        .select(
            *others, kind.alias("kind"), named.alias("_named"),
            F.when(reason != "", reason).otherwise(fixed.DEFAULT_RATIONALE).alias("rationale"),
        )
        .select(
            *others, F.concat_ws("=", "kind", F.array_join("_named", ",")).alias("action"),
            F.filter(F.transform("_named", lambda i: i.try_cast("bigint")), lambda i: i.isNotNull()).alias("iters"), "rationale",
        )
    )


def parse_merge(responses: DataFrame, text: str = "text") -> DataFrame:
    """Rationale and artifact of a merge response."""
    others = [c for c in responses.columns if c != text]
    return responses.select(
        *others, rationale_of(F.col(text)).alias("rationale"), prompt_of(F.col(text)).alias("artifact")
    )


def user_constraints(notes: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """One row per user section of a notebook, in order."""
    others = [c for c in notes.columns if c != text]
    return notes.select(*others, F.posexplode(user_sections(text, strict)).alias("_at", "constraint")).select(
        *others, (F.col("_at") + 1).cast("bigint").alias("position"), "constraint"
    )


def notes_summary(notes: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Numbered constraints, and the whole text if it is short or else its end."""
    others = [c for c in notes.columns if c != text]
    found = user_sections(text, strict)
    numbered = F.transform(found, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    constraints = F.when(
        F.size(found) > 0,
        F.concat(F.lit(fixed.NOTES_CONSTRAINTS + "\n"), F.array_join(numbered, "\n"), F.lit("\n\n")),
    ).otherwise("")
    content = F.when(
        F.length(text) < fixed.NOTES_FULL_CHARS, F.concat(F.lit(fixed.NOTES_FULL + "\n"), F.col(text))
    ).otherwise(F.concat(F.lit(fixed.NOTES_RECENT + "\n"), F.right(F.col(text), F.lit(fixed.NOTES_TAIL_CHARS))))
    summary = F.when(strip(F.col(text)) == "", fixed.NOTES_EMPTY).otherwise(
        F.concat(F.lit(fixed.NOTES_TITLE + "\n\n"), constraints, content)
    )
    return notes.select(*others, F.size(found).cast("bigint").alias("constraints"), summary.alias("summary"))


def term_tree(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of the terms' words, as written tables: ``node, word, next`` and ``node, _run, _size`` for its ends.

    ``terms`` has ``_run`` and ``_words``. A node is named by a digest of the words that lead to it; the root's name is
    empty. Terms that begin alike share their edges.
    """
    step = lambda seen, word: F.concat(seen, F.array(F.sha2(F.concat(F.element_at(seen, -1), F.lit(" "), word), 256)))
    walked = settle(terms.where(F.size("_words") > 0).distinct().withColumn("_nodes", F.aggregate("_words", F.array(F.lit("")), step)), "terms")
    steps = F.arrays_zip(F.slice("_nodes", 1, F.size("_words")).alias("node"), F.col("_words").alias("word"), F.slice("_nodes", 2, F.size("_words")).alias("next"))
    edges = walked.select(F.explode(steps).alias("e")).select("e.node", "e.word", "e.next").distinct()
    ends = walked.select(F.element_at("_nodes", -1).alias("node"), "_run", F.size("_words").alias("_size"))
    return settle(edges, "term-edges"), settle(ends, "term-ends")


def mentions(spoken: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _run`` of all terms that ``_words`` of ``spoken`` hold in a row; both sides have ``_words``.

    The words walk the prefix tree side by side: each word that begins a term is a living prefix, and every round joins
    the living ones with the tree on (node, next word), so only those that a term goes on with remain. Rounds are written
    tables; there are as many as the longest living prefix has words.
    """
    edges, ends = term_tree(terms)
    longest = ends.agg(F.max("_size")).first()[0] or 0
    starts = spoken.select(*keys, F.posexplode("_words").alias("_at", "word"))
    living = starts.join(edges.where(F.col("node") == "").select("word", "next"), "word").select(*keys, "_at", F.col("next").alias("node"))
    if longest > 1:
        # The words that can follow are fetched for the living ones only.
        follow = F.slice("_words", F.col("_at") + 2, longest - 1).alias("_follow")
        living = join_on(living, spoken, keys).select(*keys, "node", follow)
    else:
        living = living.select(*keys, "node", F.array().cast("array<string>").alias("_follow"))
    found = None
    for turn in range(longest):
        if turn:
            going = living.where(F.size("_follow") >= turn).withColumn("word", F.element_at("_follow", turn))
            living = going.join(edges, ["node", "word"]).select(*keys, F.col("next").alias("node"), "_follow")
        living = settle(living, "living-prefixes")
        ended = living.join(ends, "node").select(*keys, "_run")
        found = ended if found is None else found.unionByName(ended)
        if living.isEmpty():
            break
    return spoken.select(*keys, F.lit(None).cast("string").alias("_run")).limit(0) if found is None else found.distinct()


def constraint_filter(candidates: DataFrame, terms: DataFrame, keys: Sequence[str] = ("run_id", "candidate_id")) -> DataFrame:
    """Candidates whose plan and rationale mention no banned term.

    ``keys`` identify a candidate. Terms with a ``run_id`` hold in that run, those without (null,
    or no such column) in all. A mention is the term's words in a row, whatever their case; terms can
    be of any length.
    """
    keys = list(keys)
    run = F.col("run_id").cast("string") if "run_id" in terms.columns else F.lit(None).cast("string")
    spoken = candidates.select(*keys, words(F.concat_ws(" ", "plan_id", "rationale")).alias("_words"))
    found = mentions(spoken, terms.select(run.alias("_run"), words("term").alias("_words")), keys)
    if "run_id" in keys:
        found = found.where(F.col("_run").isNull() | (F.col("_run") == F.col("run_id").cast("string")))
    return join_on(candidates, found.select(*keys).distinct(), keys, "left_anti")


def repeat_proposals(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates whose text, or whose plan for the same parent, is in the log already."""
    hashed = candidates.withColumn("artifact_hash", sha16("artifact"))
    texts = log.select("run_id", "artifact_hash", F.lit(True).alias("same_text")).distinct()
    plans = log.where(F.col("parent").isNotNull()).select(
        "run_id", "parent", "plan_id", F.lit(True).alias("same_plan")
    ).distinct()
    found = hashed.join(texts, ["run_id", "artifact_hash"], "left").join(plans, ["run_id", "parent", "plan_id"], "left")
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in ("same_text", "same_plan")]
    return found.select(*hashed.columns, *flags).where(F.col("same_text") | F.col("same_plan"))
