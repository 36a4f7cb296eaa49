"""Quality rules: a decision list learned from labelled text statistics, on DataFrame functions only.

``statistics`` describes each whole text by counts. ``learn`` covers the bad labelled rows rule by rule: a rule grows as a
conjunction of thresholds with the best FOIL gain on one part of the labelled rows, is pruned to its best prefix on the
other part, and the rows it takes leave the table. ``DecisionList.verdict`` turns the list into one ordered Spark
conditional. Only counts per (feature, bin) reach the driver: at most features x bins rows for each condition.

Nulls: a null text counts as no words. Labels that are null are not used; of several labels of a document the worst
counts. Without labels of both classes there are no rules, and only the base rule decides. Repeated rows are described
one by one. Columns other than the named ones are not touched and may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import SEPARATORS, let
from evalspark.plans.shared import settle

WINDOW = 5
MIN_WORDS = 10
#: Per cent of the words that may stand in repeated windows.
MAX_REPEATED = 20
#: Thresholds are taken from this many quantiles of all labelled rows, and of the bad ones.
QUANTILES = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
#: A rule is accepted if at least this share of what it takes is bad, on the rows held back for pruning.
MIN_PRECISION = 0.95
#: Labelled rows used for learning; above it, a hash of doc_id picks as many (in expectation).
MAX_LABELLED = 500_000

FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "word_length", "line_words")


def _repeated_words(words: Column) -> Column:
    """Words that stand in a window of five found at least twice; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            same = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (F.get(s, i - 1)["h"] == F.get(s, i)["h"]) | (F.get(s, i + 1)["h"] == F.get(s, i)["h"]),
            )
            return F.sort_array(F.transform(same, lambda i: F.get(s, i)["i"]))

        def total(p: Column) -> Column:
            # A flagged window adds its words up to the start of the next flagged window.
            steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.get(p, k + 1) - v))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(places, lambda s: let(flagged(s), total))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    repeated = let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )
    return F.when(F.size(words) > WINDOW, repeated).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of the whole text, one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SEPARATORS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")),
    )
    return docs.select(
        "doc_id",
        (F.length(text) - F.regexp_count(text, F.lit(SEPARATORS))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        of_words.alias("_w"),
        of_lines.alias("_l"),
    ).select("doc_id", "word_chars", "n_symbols", "n_upper", "_w.*", "_l.*")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios of the counts, 0 where the denominator is 0."""

    def share(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first one that holds rejects, otherwise the document is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, columns: dict[str, Column]) -> Column:
        """Text of the first rule that holds; null if none does."""
        out = None
        for rule in self.rules:
            holds = F.lit(True)
            for condition in rule:
                holds = holds & condition.column(columns)
            name = F.lit(" and ".join(map(str, rule)))
            out = F.when(holds, name) if out is None else out.when(holds, name)
        return F.lit(None).cast("string") if out is None else out


def labelled_rows(stats: DataFrame, labels: DataFrame, label: str = "quality", bad: int = 0, limit: int = MAX_LABELLED) -> DataFrame:
    """Features of labelled documents, ``bad`` (1 or 0), and ``grow`` (two thirds grow rules, one third prunes)."""
    worst = F.max((F.col(label) == bad).cast("int"))
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(worst.alias("bad"))
    share = min(1.0, limit / max(1, marks.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    marks = marks.filter(draw < F.lit(math.ceil(share * 1_000_003)))
    return stats.join(marks, "doc_id").select(
        *[c.alias(n) for n, c in features().items()], "bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow")
    )


def _binned(rows: DataFrame, quantiles: int) -> DataFrame:
    """One row per labelled row with an array of (feature, bin, value)."""
    points = [k / quantiles for k in range(quantiles + 1)]
    asked = [F.percentile_approx(f, points, 2000).alias(f) for f in FEATURES]
    asked += [F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), points, 2000).alias(f"bad_{f}") for f in FEATURES]
    found = rows.agg(*asked).first().asDict()
    cells = []
    for f in FEATURES:
        cuts = F.array(*[F.lit(float(c)) for c in sorted({*(found[f] or []), *(found[f"bad_{f}"] or [])})])
        value = F.col(f)
        place = F.size(F.filter(cuts, value.__gt__))
        cells.append(F.struct(F.lit(f).alias("feature"), place.alias("bin"), value.alias("value")))
    return rows.select(*FEATURES, "bad", "grow", F.array(*cells).alias("cells"))


def _tables(rows: DataFrame) -> dict[str, list[dict]]:
    """Counts per bin of each feature, in order of the bins."""
    cells = rows.select("bad", "grow", F.explode("cells").alias("c"))
    count = lambda bad, grow: F.count_if((F.col("bad") == bad) & (F.col("grow") == grow))
    found = cells.groupBy("c.feature", "c.bin").agg(
        count(1, True).alias("p"), count(0, True).alias("n"), count(1, False).alias("held_p"), count(0, False).alias("held_n"),
        F.min("c.value").alias("low"), F.max("c.value").alias("high"),
    )
    tables: dict[str, list[dict]] = {f: [] for f in FEATURES}
    for row in found.collect():  # at most features x (2 x quantiles + 3) rows
        tables[row["feature"]].append(row.asDict())
    return {f: sorted(t, key=lambda r: r["bin"]) for f, t in tables.items()}


def _best(tables: dict[str, list[dict]]) -> tuple[Condition, dict] | None:
    """The condition with the largest FOIL gain; of equal ones that with the widest gap at its threshold."""
    options = []
    for feature, table in tables.items():
        whole = {k: sum(r[k] for r in table) for k in ("p", "n", "held_p", "held_n")}
        if not whole["p"]:
            return None
        before = math.log2(whole["p"] / (whole["p"] + whole["n"]))
        below = dict.fromkeys(whole, 0)
        width = (table[-1]["high"] - table[0]["low"]) or 1.0
        for left, right in zip(table, table[1:], strict=False):
            below = {k: v + left[k] for k, v in below.items()}
            for above in (True, False):
                taken = {k: whole[k] - v for k, v in below.items()} if above else below
                if taken["p"]:
                    gain = taken["p"] * (math.log2(taken["p"] / (taken["p"] + taken["n"])) - before)
                    middle = (left["high"] + right["low"]) / 2
                    options.append((round(gain, 9), (right["low"] - left["high"]) / width, feature, above, middle, taken))
    if not options:
        return None
    gain, _, feature, above, middle, taken = max(options, key=lambda o: o[:4])
    return (Condition(feature, above, middle), taken) if gain > 0 else None


def _worth(counts: dict) -> float:
    taken = counts["held_p"] + counts["held_n"]
    return (counts["held_p"] - counts["held_n"]) / taken if taken else -1.0


def learn(
    labelled: DataFrame, quantiles: int = QUANTILES, max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION,
) -> DecisionList:
    """Sequential covering over ``labelled_rows``; runs one small aggregation for each condition."""
    rows = settle(_binned(settle(labelled, "labelled"), quantiles), "labelled-bins")
    columns = {f: F.col(f) for f in FEATURES}
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        left = rows.filter(DecisionList(rules).verdict(columns).isNull())
        grown: list[tuple[Condition, dict]] = []
        while len(grown) < max_conditions:
            inside = left
            for condition, _ in grown:
                inside = inside.filter(condition.column(columns))
            found = _best(_tables(inside))
            if not found:
                break
            grown.append(found)
            if not found[1]["n"]:
                break
        if not grown:
            break
        # Prune to the prefix that does best on the rows that did not grow the rule; the shorter of equal ones.
        worth = [_worth(counts) for _, counts in grown]
        keep = worth.index(max(worth)) + 1
        counts = grown[keep - 1][1]
        if counts["held_p"] < min_precision * (counts["held_p"] + counts["held_n"]) or not counts["held_p"]:
            break
        rules.append([condition for condition, _ in grown[:keep]])
    return DecisionList(rules)


def apply(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``base_failed``, ``rule`` (the one that rejects, or null) and ``kept``."""
    failed = base_failed()
    rule = rules.verdict(features())
    return stats.withColumns({"base_failed": failed, "rule": rule, "kept": ~failed & rule.isNull()})


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Describe every document once, learn from the labelled ones, and judge all."""
    stats = settle(statistics(docs), "text-statistics")
    return apply(stats, learn(labelled_rows(stats, labels)))
