"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

Equal texts form one group and stay together; a group is a point in metadata space (size, source, language, smallest
doc_id; strings by their rank among the distinct ones) that weighs its bytes. A node of the tree is split at a weighted median along the dimension in which it is
widest, until each leaf has its target bytes. Medians are found without sorting: bytes are summed in up to 1,024 bins of
each node, and the bin that holds the median is binned again, until its weight is below the tolerance or it holds one
key. Each such pass is one aggregation; nodes x bins rows reach the driver.

Keys end in a hash of the text, so a node whose points are equal in a dimension can be cut there too. Shards differ by
the tolerance, or by the bytes of a group of copies where such a group is larger.

Nulls: a null text counts one byte and is a text of its own; a null source or language comes before all others.
Repeated rows are kept as they are. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import numbered, running_sum
from evalspark.plans.shared import settle

BINS = 1024
#: Share of a leaf's target bytes that may lie on the wrong side of a cut.
TOLERANCE = 0.0005
DIMENSIONS = ("by_size", "by_source", "by_lang", "by_id")
_SCALE = 2**30


@dataclass
class Node:
    """``number`` of the first leaf below it, and how many leaves it has; a dimension and a cut once it is split."""

    number: int
    leaves: int
    dimension: str = ""
    cut: int = 0
    children: tuple[Node, Node] | None = None

    def leaf(self) -> Column:
        """The shard of a point, as one nested conditional."""
        if not self.children:
            return F.lit(self.number)
        left, right = self.children
        return F.when(F.col(self.dimension) <= F.lit(self.cut), left.leaf()).otherwise(right.leaf())

    def open(self) -> list[Node]:
        return [n for c in self.children for n in c.open()] if self.children else [self] * (self.leaves > 1)


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows: ``doc_id, source, lang, size`` (UTF-8 bytes plus 1), ``text_crc32`` and a hash of the text."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        "doc_id", "source", "lang", (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"), F.xxhash64(F.col("text"), F.col("text").isNull()).alias("_text"),
    )


def points(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its bytes, and a key of 62 bits for each dimension."""
    groups = settle(
        rows.groupBy("_text").agg(
            F.sum("size").alias("bytes"), F.min("size").alias("size"), F.min("source").alias("source"),
            F.min("lang").alias("lang"), F.min("doc_id").alias("doc_id"),
        ),
        "text-groups",
    )

    for name in ("source", "lang"):
        # Strings stand at their rank among the distinct ones, null first; the ranks come from a range partitioning.
        ranks = numbered(groups.select(F.col(name).alias("_value")).distinct(), [], ["_value"], f"{name}_rank")
        groups = groups.join(ranks, F.col(name).eqNullSafe(F.col("_value"))).drop("_value")
    code = lambda name: F.col(f"{name}_rank").cast("double")
    values = {"by_size": F.log2("size"), "by_source": code("source"), "by_lang": code("lang"), "by_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}
    range_ = groups.agg(*[f(v).alias(f"{n}_{k}") for n, v in values.items() for k, f in (("low", F.min), ("high", F.max))]).first()
    low32 = F.col("_text").bitwiseAND(0xFFFFFFFF)
    keys = []
    for name, value in values.items():
        low, high = range_[f"{name}_low"] or 0.0, range_[f"{name}_high"] or 0.0
        scaled = F.floor((value - F.lit(low)) / F.lit((high - low) or 1.0) * (_SCALE - 1)).cast("long")
        keys.append(F.shiftleft(scaled, 32).bitwiseOR(low32).alias(name))
    return settle(groups.select("_text", "bytes", *keys), "text-points")


def _by_node(nodes: list[Node], value) -> Column:
    out = None
    for node in nodes:
        mine = F.col("_node") == node.number
        out = F.when(mine, F.lit(value(node))) if out is None else out.when(mine, F.lit(value(node)))
    return out


def _split(rows: DataFrame, root: Node, nodes: list[Node], tolerance: float) -> None:
    """Cut all open nodes of one level."""
    level = rows.withColumn("_node", root.leaf()).filter(F.col("_node").isin([n.number for n in nodes]))
    found = level.groupBy("_node").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))])
    whole = {r["_node"]: r for r in found.collect()}  # one row per node
    nodes = [n for n in nodes if n.number in whole]
    span, left, goal = {}, {}, {}
    for node in nodes:
        r = whole[node.number]
        node.dimension = max(DIMENSIONS, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
        span[node.number] = (r[f"low_{node.dimension}"], r[f"high_{node.dimension}"])
        left[node.number], goal[node.number] = 0, r["bytes"] * (node.leaves // 2) / node.leaves
    todo = list(nodes)
    while todo:
        key = None
        for node in todo:
            mine = F.col("_node") == node.number
            key = F.when(mine, F.col(node.dimension)) if key is None else key.when(mine, F.col(node.dimension))
        width = lambda n: max(1, math.ceil((span[n.number][1] - span[n.number][0] + 1) / BINS))
        binned = (
            level.filter(F.col("_node").isin([n.number for n in todo])).withColumn("_key", key)
            .filter(F.col("_key").between(_by_node(todo, lambda n: span[n.number][0]), _by_node(todo, lambda n: span[n.number][1])))
            .withColumn("_low", _by_node(todo, lambda n: span[n.number][0])).withColumn("_width", _by_node(todo, width))
            .groupBy("_node", F.expr("(_key - _low) div _width").alias("_bin"))
            .agg(F.sum("bytes").alias("bytes"), F.min("_key").alias("first"), F.max("_key").alias("last"))
        )
        table: dict[int, list] = {}
        for r in binned.collect():  # nodes x bins rows
            table.setdefault(r["_node"], []).append(r)
        again = []
        for node in todo:
            held = left[node.number]
            bins = sorted(table[node.number], key=lambda r: r["_bin"])
            for r in bins:
                if held + r["bytes"] >= goal[node.number] or r is bins[-1]:
                    break
                held += r["bytes"]
            if r["first"] == r["last"] or r["bytes"] <= tolerance:
                # Cut after this bin or before it, whichever is nearer to the goal.
                over = held + r["bytes"] - goal[node.number] <= goal[node.number] - held
                node.cut = r["last"] if over else r["first"] - 1
            else:
                span[node.number], left[node.number] = (r["first"], r["last"]), held
                again.append(node)
        todo = again
    for node in nodes:
        half = node.leaves // 2
        node.children = (Node(node.number, half), Node(node.number + half, node.leaves - half))


def build(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Node:
    """The tree over ``points``; about log2(shards) levels of a few aggregations each."""
    root = Node(0, shards)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    while total and (nodes := root.open()):
        before = len(nodes)
        _split(rows, root, nodes, tolerance * total / shards)
        if len([n for n in root.open() if n in nodes]) == before:
            break  # only empty nodes are left
    return root


def shards_for(total_bytes: int, target_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; slots count from 0 in each shard, in order of a hash of doc_id."""
    rows = settle(sized(docs), "sized-documents")
    groups = points(rows)
    tree = build(groups, shards)
    placed = settle(groups.select("_text", tree.leaf().cast("int").alias("shard")), "text-shards")
    bits = max(8, math.ceil(math.log2(max(1, rows.count() / shards / 20_000))))
    rows = rows.join(placed, "_text").withColumn("_key", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1)).withColumn("_one", F.lit(1))
    rows = running_sum(rows, ["shard"], ["_key", "doc_id", "text_crc32"], "_one", "slot", F.shiftright("_key", 63 - bits))
    return rows.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"))
