"""Row-local text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions import fixed
from evalspark.functions.hashing import as_column


def strip(text: Column) -> Column:
    """Remove white space of every kind on both sides (SQL trim removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def shorten(text: Column, limit: int) -> Column:
    """The text, cut to ``limit`` characters and marked with dots if it is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def find(text: Column, pattern: str) -> Column:
    """First group of the pattern, stripped; empty where it does not occur."""
    return strip(F.regexp_extract(text, pattern, 1))


def plan_of(part: Column) -> Column:
    found = F.regexp_extract(part, fixed.PLAN_ID_PATTERN, 1)
    return F.when(found != "", found).otherwise(F.lit(fixed.UNKNOWN_PLAN))


def rationale_of(part: Column) -> Column:
    return find(part, fixed.RATIONALE_PATTERN)


def prompt_of(part: Column) -> Column:
    return find(part, fixed.PROMPT_PATTERN)


def user_sections(text: Column | str, strict: bool = True) -> Column:
    """Array of the bodies of the user sections of one notebook text.

    The text is cut in front of every heading line; no lines are exploded. ``strict`` takes only
    second-level headings as headings, wants ``## USER`` to stand alone or be followed by white
    space, and drops empty bodies. Otherwise any line starting with ``##`` is a heading, any
    heading starting with ``## USER`` opens a user section, and blank bodies stay as ``''``.
    """
    text = as_column(text)
    heading = "##(?!#)" if strict else "##"
    opens = rf"^{fixed.USER_HEADING}(\s|$)" if strict else rf"^{fixed.USER_HEADING}"
    parts = F.split(F.concat(F.lit("\n"), text), rf"\n(?={heading})")
    # The first part is what stands before any heading, so it never opens a section.
    mine = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike(opens))
    if not strict:
        mine = F.filter(mine, lambda p: F.instr(p, "\n") > 0)
    bodies = F.transform(mine, lambda p: strip(F.regexp_replace(p, r"^[^\n]*\n?", "")))
    return F.filter(bodies, lambda b: b != "") if strict else bodies


def words(text: Column | str) -> Column:
    """Lower-case words of a text (letters and digits of any language)."""
    return F.filter(F.split(F.lower(as_column(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
