"""A Merkle manifest of a table: leaves, a tree per group, a tree over the groups, and a proof for every row.

A leaf is the hash of a row's fields, each written with its length, so no two rows read alike. The leaves of a group stand
in order and are numbered without gaps. Every level of a tree is an equijoin of its nodes with themselves: a node looks up
the index of its sibling, which is its own with the last bit flipped for binary trees, and its slot shifted by 1, 2, ...
within the run of ``arity`` nodes otherwise. Then the rows of slot zero, which know their whole run, emit the parents. The
siblings met on the way up are a row's proof; going down, each node hands its own to its children. Leaves are numbered by
range partitions whose counts are carried forward, so neither a group nor the table is ever in one task.

Nulls: a null field is written ``-``; rows with a null group are a group of their own, the first one; a null order value
comes first. Rows that are equal in all fields have equal leaves and stand side by side. A group of one row has its leaf
as root. An empty table gives no rows. Columns that are not fields are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import numbered
from evalspark.plans.shared import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(field: Column) -> Column:
    """A field as its number of UTF-8 bytes, a colon and its value; ``-`` for null."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``others``, the hashes of a node's siblings from left to right (binary, 32 bytes each)."""
    if arity == 2:
        sibling = nodes.select(F.col("g").alias("_g"), F.col("i").bitwiseXOR(F.lit(1).cast("long")).alias("_i"), F.col("hash").alias("_h"))
        joined = nodes.join(sibling, (F.col("g") == F.col("_g")) & (F.col("i") == F.col("_i")), "left")
        return joined.select(*nodes.columns, F.coalesce("_h", F.lit(b"")).alias("others"))
    slot, found, out = F.col("i") % arity, [], nodes
    for offset in range(1, arity):
        # The node at slot s is looked up by the one whose slot is s - offset, within the run.
        wanted = F.col("i") - slot + F.pmod(slot - offset, F.lit(arity).cast("long"))
        sibling = nodes.select(
            F.col("g").alias(f"_g{offset}"), wanted.alias(f"_i{offset}"), F.struct(F.col("i").alias("at"), "hash").alias(f"_s{offset}")
        )
        out = out.join(sibling, (F.col("g") == F.col(f"_g{offset}")) & (F.col("i") == F.col(f"_i{offset}")), "left")
        found.append(F.col(f"_s{offset}"))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    joined = F.aggregate(ordered, F.lit(b""), lambda held, s: F.concat(held, s["hash"]))
    return out.select(*nodes.columns, joined.alias("others"))


def climb(nodes: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees with siblings, from the leaves up, and the roots (``g, hash``).

    ``nodes`` has ``g`` (group), ``n`` (nodes of the group at this level), ``i`` (from 0) and ``hash`` (binary); more
    columns stay on the lowest level, which keeps groups of one node. Each level is a written table of 1/arity the size.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, at, roots = [], nodes, nodes.filter("n = 1").select("g", "hash")
    while most > 1 or not levels:
        level = settle(with_siblings(at, arity), "merkle-level")
        levels.append(level)
        whole = F.unhex(digest(_hex(F.col("hash")), _hex(F.col("others"))))
        up = level.filter((F.col("n") > 1) & (F.col("i") % arity == 0)).select(
            "g", F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.expr(f"i div {arity}").alias("i"), whole.alias("hash")
        )
        roots = roots.unionByName(up.filter("n = 1").select("g", "hash"))
        at, most = up.filter("n > 1"), -(-most // arity)
    return levels, settle(roots, "merkle-roots")


def with_paths(levels: Sequence[DataFrame], arity: int = 2) -> DataFrame:
    """The lowest level with ``path``: the ``others`` of a node and of all nodes above it, below the root."""
    path = None
    for level in reversed(levels):
        own = F.when(F.col("n") > 1, F.array("others")).otherwise(F.array().cast("array<binary>"))
        if path is None:
            found = level.withColumn("path", own)
        else:
            above = path.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_path"))
            joined = level.join(above, (F.col("g") == F.col("_g")) & (F.expr(f"i div {arity}") == F.col("_i")), "left")
            found = joined.withColumn("path", F.concat(own, F.coalesce("_path", F.array().cast("array<binary>")))).drop("_g", "_i", "_path")
        path = found.drop("others")
    return path


def fold(leaf: Column, index: Column, path: Column, arity: int = 2) -> Column:
    """The root (hex) that a leaf (hex) and the siblings on its path give."""

    def up(state: Column, others: Column) -> Column:
        slot, near = (state["i"] % arity).cast("int"), _hex(others)
        above = digest(F.substring(near, F.lit(1), 64 * slot), state["hash"], F.substring(near, 64 * slot + 1, F.length(near)))
        return F.struct(above.alias("hash"), F.floor(state["i"] / arity).cast("long").alias("i"))

    start = F.struct(leaf.alias("hash"), index.cast("long").alias("i"))
    return F.aggregate(path, start, up, lambda state: state["hash"])


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
    altered: Mapping[str, Column] | None = None, arity: int = 2,
) -> DataFrame:
    """``order, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row of ``docs``.

    ``altered`` gives other values of fields, as expressions over ``docs``: the leaf that is folded along the proof is
    made from them, and ``verified`` tells whether the root came out.
    """
    altered = altered or {}
    values = [F.col(f) for f in fields]
    leaf = digest(*map(written, values))
    changed = F.lit(False)
    for name, value in altered.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    other = F.when(changed, digest(*[written(altered.get(f, F.col(f))) for f in fields]))
    rows = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), F.unhex(leaf).alias("hash"), F.unhex(other).alias("_other"))
    rows = numbered(settle(rows, "merkle-leaves"), ["_group"], ["_order", "hash"], "i", "n")
    groups = numbered(rows.select("_group").distinct(), [], ["_group"], "g", "_groups")
    names = groups.select(F.col("_group").alias("_name"), "g")
    nodes = rows.join(names, F.col("_group").eqNullSafe(F.col("_name"))).drop("_group", "_name")
    levels, subroots = climb(nodes, arity)
    tops = groups.join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.col("_groups").alias("n"), F.col("g").alias("i"), "hash")
    upper, root = climb(tops, arity)
    top = root.first()  # one row
    above = with_paths(upper, arity).select(F.col("i").alias("_g"), _hex(F.col("hash")).alias("subroot"), F.col("path").alias("_above"))
    leaves = with_paths(levels, arity).join(settle(above, "merkle-groups"), F.col("g") == F.col("_g"))
    own, whole = _hex(F.col("hash")), F.concat("path", "_above")
    found = fold(F.coalesce(_hex(F.col("_other")), own), F.col("i"), F.col("path"), arity)
    proof = F.sha2(F.array_join(F.transform(whole, _hex), ""), 256)
    out = leaves.select(
        F.col("_order").alias(order), own.alias("leaf"), "subroot", F.lit(top["hash"].hex() if top else None).cast("string").alias("root"),
        proof.alias("proof_sha256"), fold(found, F.col("g"), F.col("_above"), arity).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
