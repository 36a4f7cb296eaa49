"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its assistant texts are
intersected with the token spans by binary search. Control strings inside texts are escaped by one more backslash after
their first character, which is reversible: ``</s>`` becomes ``<\\/s>``, and ``<\\/s>`` becomes ``<\\\\/s>``.

Nulls: a null text or role is empty; a null conversation id is a conversation of its own; a null turn comes first. Rows
are ordered by (turn, role, text), repeated rows stay. A conversation is the unit of encoding, so it must fit in a task.
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import load_tokenizer, slices

#: Strings that models read as control; all forms ``<|...|>`` begin with the first.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "<|/turn|>\n"
#: Bytes of text encoded at a time.
SLICE = 2_000_000


def _pattern(extra: str) -> str:
    quoted = "|".join("\\Q" + c[1:] + "\\E" for c in sorted(CONTROLS, key=len, reverse=True))
    return rf"([<\[])(\\*){extra}({quoted})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(""), r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(r"\\"), "$1$2$3")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, heads, bodies, in_loss``: the text and, per turn, the lengths of its parts."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    parts = F.transform(
        "_turns",
        lambda t: F.struct(
            F.concat(F.lit("<|"), F.url_encode(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    whole = whole.select("conv_id", parts.alias("_parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform("_parts", lambda p: F.length(p["head"])).alias("heads"),
        F.transform("_parts", lambda p: F.length(p["body"])).alias("bodies"),
        F.transform("_parts", lambda p: p["loss"]).alias("in_loss"),
    )


def intersect(token_begin: np.ndarray, token_end: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that touch a span, and the character ranges they cover inside the spans, merged.

    Tokens are sorted by offset; spans are sorted, apart and not empty. Several tokens may share a character.
    """
    first = np.searchsorted(end, token_begin, side="right")
    last = np.searchsorted(begin, token_end, side="left")
    touched = last > first
    # A token longer than the gap between two spans belongs to several of them.
    token = np.repeat(np.arange(len(token_begin)), np.maximum(last - first, 0))
    span = first[token] + np.arange(len(token)) - np.repeat(np.cumsum(np.maximum(last - first, 0)) - np.maximum(last - first, 0), np.maximum(last - first, 0))
    left, right = np.maximum(token_begin[token], begin[span]), np.minimum(token_end[token], end[span])
    real = right > left
    touched[:] = False
    touched[token[real]] = True
    left, right, span = left[real], right[real], span[real]
    if not len(left):
        return touched, left, right
    reach = np.maximum.accumulate(right)
    starts = np.concatenate(([True], (left[1:] > reach[:-1]) | (span[1:] != span[:-1])))
    heads = np.flatnonzero(starts)
    return touched, left[heads], reach[np.concatenate((heads[1:] - 1, [len(left) - 1]))]


def encode(rendered: DataFrame, tokenizer_json: str) -> DataFrame:
    """Adds ``ids``, ``loss`` (per token) and the character ranges ``loss_begin``, ``loss_end`` under the mask.

    ``tokenizer_json`` is the content of a tokenizers file; special tokens in texts are ordinary text.
    """
    held = rendered.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(held.value, True)
        for batch in slices(batches, "formatted", SLICE):
            out: dict[str, list] = {"ids": [], "loss": [], "loss_begin": [], "loss_end": []}
            for text, heads, bodies, marked in zip(*(batch.column(c).to_pylist() for c in ("formatted", "heads", "bodies", "in_loss")), strict=True):
                found = tokenizer.encode(text, add_special_tokens=False)
                spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
                heads, bodies, marked = np.array(heads, np.int64), np.array(bodies, np.int64), np.array(marked, bool) & (np.array(bodies) > 0)
                begin = np.cumsum(heads + bodies + len(END)) - bodies - len(END)
                touched, left, right = intersect(spans[:, 0], spans[:, 1], begin[marked], (begin + bodies)[marked])
                out["ids"].append(found.ids)
                out["loss"].append(touched)
                out["loss_begin"].append(left)
                out["loss_end"].append(right)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("formatted"), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["loss"], pa.list_(pa.bool_())), pa.array(out["loss_begin"], pa.list_(pa.int32())), pa.array(out["loss_end"], pa.list_(pa.int32()))],
                ["conv_id", "formatted", *out],
            )

    kind = rendered.schema["conv_id"].dataType.simpleString()
    return rendered.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss array<boolean>, loss_begin array<int>, loss_end array<int>")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    turn = r"<\|([^|/]*)\|>\n((?s:.*?))<\|/turn\|>\n"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(F.transform(roles, F.url_decode).alias("role"), F.transform(texts, unescape).alias("text"))


def loss_text(formatted: Column, begin: Column, end: Column) -> Column:
    """All text under the mask, unescaped range by range."""
    return F.array_join(F.zip_with(begin, end, lambda a, b: unescape(F.substring(formatted, a + 1, b - a))), "")


def format_chats(turns: DataFrame, tokenizer_json: str) -> DataFrame:
    return encode(render(turns), tokenizer_json)
