"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its word shingles. Its signature has 48 minima, 14 bits of each, in 12 chunks of 4. Two
signatures that differ in at most 23 places have, by the pigeonhole principle, a chunk with at most one difference, so
they agree on a chunk with one of its four places left out: every document is filed under 12 x 4 such keys, and all
pairs within the signature distance meet. At a similarity of 0.8, a pair lies beyond that distance with probability
0.000003.

Pairs are not listed within groups. Copies (equal sequences of words) are one text. Under each key all texts meet the
first one only; links are confirmed on the full sets and joined to components. What is left are keys whose texts still
lie in several components: there, texts outside the key's main component meet the others within the signature distance.
So a group of n near copies costs n pairs, and no link between different components is missed. Before texts are fetched,
pairs must also pass a parity sketch: each bit tells whether an odd number of the set's shingles fall on it, so two
sketches never differ in more bits than the sets differ in shingles, and a pair over the bound cannot be a link.

Nulls: texts that are null or without words have no set and no link. A null doc_id has no links and names no component.
Rows with one doc_id are one document. Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import identified, matrix, slices, sorted_groups, tidy
from evalspark.llm.components import components
from evalspark.plans.shared import settle

PLACES, CHUNK = 48, 4
CHUNKS = PLACES // CHUNK
#: One error in a chunk is enumerated, so this many differences in all are found for certain.
MAX_DISTANCE = 2 * CHUNKS - 1
_VALUE_BITS, _LANE_BITS = 14, 15
_LANES = sum(((1 << _VALUE_BITS) - 1) << (_LANE_BITS * k) for k in range(CHUNK))
_FLAGS = sum(1 << (_LANE_BITS * k + _VALUE_BITS) for k in range(CHUNK))
#: Bits of the parity sketch.
PARITY = 1024
KEPT_WORDS = 300_000
#: Texts on one side of a comparison within a key.
TILE = 1024
#: Shingles of texts that a task keeps while it confirms pairs.
KEPT_SHINGLES = 4_000_000
SLICE = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Hashes of words are kept per worker process."""

    def __init__(self, width: int):
        self.factors = _numbers(1, width) | np.uint64(1)
        self.width, self.words = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        kept = self.words
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for word in set(words).difference(kept):
            kept[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """The words, and the distinct shingles; fewer words than the width are one shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return words, np.zeros(0, np.uint64)
        hashes, width = self.hashes(words), min(self.width, len(words))
        rows = len(words) - width + 1
        total = np.full(rows, width, np.uint64)
        for k in range(width):
            total += _mix(hashes[k : k + rows] + np.uint64(k)) * self.factors[k]
        return words, np.unique(_mix(total))


def signature(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """One number per chunk: four lanes of 15 bits, 14 of each used."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 4096):
        part = shingles[begin : begin + 4096, None] * scale + shift
        least = np.minimum(least, part.min(axis=0))
    values = (_mix(least) & np.uint64((1 << _VALUE_BITS) - 1)).reshape(CHUNKS, CHUNK)
    lanes = np.array([_LANE_BITS * k for k in range(CHUNK)], np.uint64)
    return (values << lanes).sum(axis=1, dtype=np.uint64).astype(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit by bit, whether the number of shingles that fall on it is odd."""
    counts = np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, sequence, signature, parity``; the last three are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        scale, shift = _numbers(2, PLACES) | np.uint64(1), _numbers(3, PLACES)
        for batch in slices(batches, "text", SLICE):
            number, sequence, signs, odd = [], [], [], []
            for text in batch.column("text").to_pylist():
                words, found = shingler.shingles(text)
                number.append(len(found))
                sequence.append(int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if words else None)
                signs.append(signature(found, scale, shift) if words else None)
                odd.append(parity(found) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(sequence, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sequence", "signature", "parity"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, sequence long, signature array<long>, parity array<long>")


def _keys() -> Column:
    """A key for each chunk and place left out: the chunk without that place."""
    masks = [_LANES & ~(((1 << _VALUE_BITS) - 1) << (_LANE_BITS * k)) for k in range(CHUNK)]
    keys = [
        F.xxhash64(F.lit(c * CHUNK + k), F.get("signature", F.lit(c)).bitwiseAND(masks[k])) for c in range(CHUNKS) for k in range(CHUNK)
    ]
    return F.array(*keys)


def distance(left: Column, right: Column) -> Column:
    """Number of places in which two signatures differ."""
    total = F.lit(0)
    for c in range(CHUNKS):
        lanes = F.get(left, F.lit(c)).bitwiseXOR(F.get(right, F.lit(c)))
        # A lane that is not zero carries into its unused top bit.
        total = total + F.bit_count((lanes + F.lit(_LANES)).bitwiseAND(_FLAGS))
    return total


def _possible(left: Column, right: Column, n_left: Column, n_right: Column, percent: int) -> Column:
    """Whether the parity sketches allow the similarity.

    Sets with similarity s and sizes x and y differ in at most (x + y) (1 - s) / (1 + s) shingles.
    """
    odd = F.lit(0)
    for k in range(PARITY // 64):
        odd = odd + F.bit_count(F.get(left, F.lit(k)).bitwiseXOR(F.get(right, F.lit(k))))
    return odd * (100 + percent) <= (n_left + n_right) * (100 - percent)


def _alike(n_left: Column, n_right: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n_left, n_right) >= percent * F.greatest(n_left, n_right)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose full sets are similar enough."""
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), "wanted-texts")
    texts = docs.select(F.col("doc_id").cast("long").alias("_node"), "text").join(wanted.hint("merge"), "_node", "left_semi")
    texts = settle(texts, "texts")
    full = pairs.join(texts.select(F.col("_node").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("_node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        kept: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches, "text_a", SLICE):
            keep = []
            for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                for node, text in ((a, left), (b, right)):
                    if node not in kept:
                        found = shingler.shingles(text)[1]
                        if held > KEPT_SHINGLES:
                            kept = {n: kept[n] for n in (a, b) if n in kept}
                            held = sum(map(len, kept.values()))
                        kept[node] = found
                        held += len(found)
                shared = len(np.intersect1d(kept[a], kept[b], assume_unique=True))
                union = len(kept[a]) + len(kept[b]) - shared
                keep.append(union > 0 and 100 * shared >= percent * union and a != b)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    rows = settle(sketches(docs, width), "sketches")
    usable = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    texts = settle(
        usable.groupBy("sequence").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("parity").alias("parity")),
        "distinct-texts",
    )
    filed = texts.select("node", "n", F.explode(_keys()).alias("key"))
    shared = filed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("members"))
    shared = settle(shared.filter(F.col("members") > 1).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "shared-keys")
    star = filed.join(shared, "key").filter((F.col("node") != F.col("hub")) & _alike(F.col("n"), F.col("hub_n"), percent))
    star = star.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = settle(confirm(settle(_near(star, texts, percent), "near-pairs"), docs, width, percent), "confirmed")
    found = settle(components(links), "components")
    rest = _across(filed, shared, texts, found, percent)
    if not rest.isEmpty():
        more = settle(confirm(rest, docs, width, percent), "confirmed")
        found = settle(components(links.unionByName(more)), "components")
    groups = texts.join(found, "node", "left").select(F.col("sequence").alias("_sequence"), F.coalesce("component", "node").alias("_component"))
    groups = settle(groups, "text-components")
    # Rows without words are spread by their id; no text has such a key but by a collision of 64 bits.
    key = F.coalesce("sequence", F.xxhash64("doc_id", F.lit("none")))
    out = rows.withColumn("_key", key).join(groups, F.col("_key") == F.col("_sequence"), "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with exactly one of each group: the least doc_id (null last), also of rows that share one."""
    rows = identified(docs)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "d.text"), width, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("of"))
    kept = rows.join(gone.hint("merge"), F.col("row") == F.col("of"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs within the signature distance whose parities allow the similarity."""
    for end in ("a", "b"):
        renamed = {"node": end, **{c: f"{c}_{end}" for c in ("n", "signature", "parity")}}
        pairs = pairs.join(texts.select([F.col(c).alias(r) for c, r in renamed.items()]), end)
    near = distance(F.col("signature_a"), F.col("signature_b")) <= MAX_DISTANCE
    return pairs.filter(near & _possible(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _across(filed: DataFrame, shared: DataFrame, texts: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs within the signature distance that share a key but lie in different components; a written table."""
    members = filed.join(shared.select("key", "hub"), "key").join(found.withColumnRenamed("component", "_c"), "node", "left")
    members = settle(members.select("key", "hub", "node", "n", F.coalesce("_c", "node").alias("component")), "members")
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mains = members.filter(F.col("node") == F.col("hub")).select("key", F.col("component").alias("main"))
    mixed = settle(mixed.filter(F.col("low") != F.col("high")).join(mains, "key").select("key", "main"), "mixed-keys")
    rows = members.join(mixed, "key").filter(F.col("node") != F.col("hub")).drop("hub", "n").join(texts.drop("sequence"), "node")
    rows = settle(rows.withColumn("_out", F.col("component") != F.col("main")), "mixed-members")
    # Texts of the main component have met its hub; they need not meet each other. Those outside it (left) meet all
    # (right), in tiles: each side of a key is dealt out by a hash, and each row goes to all tiles of the other side.
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = settle(rows.groupBy("key").agg(tiles(F.count("*")).alias("_rights"), tiles(F.count_if("_out")).alias("_lefts")), "key-sizes")
    rows = rows.join(sizes, "key")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "node", "n", "component", "main", "signature", "parity"]
    left = rows.filter("_out").select(*columns, F.lit(True).alias("left"), spot("_lefts").alias("i"), every("_rights").alias("j"))
    right = rows.filter("_lefts > 0").select(*columns, F.lit(False).alias("left"), every("_lefts").alias("i"), spot("_rights").alias("j"))
    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "i", "j"]):
            side = group.column("left").to_numpy()
            get = {c: group.column(c).to_numpy() for c in ("node", "n", "component", "main")}
            get["signature"] = matrix(group.column("signature"), CHUNKS, np.int64).view(np.uint64)
            get["parity"] = matrix(group.column("parity"), PARITY // 64, np.int64).view(np.uint64)
            left, right = ({c: v[mask] for c, v in get.items()} for mask in (side, ~side))
            for row in range(len(left["node"])):
                n, m = left["n"][row], right["n"]
                new = (right["component"] != left["component"][row]) & ((right["component"] == right["main"]) | (right["node"] > left["node"][row]))
                new &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                some = np.flatnonzero(new)
                lanes = (right["signature"][some] ^ left["signature"][row]) + np.uint64(_LANES)
                some = some[np.bitwise_count(lanes & np.uint64(_FLAGS)).sum(axis=1) <= MAX_DISTANCE]
                odd = np.bitwise_count(right["parity"][some] ^ left["parity"][row]).sum(axis=1).astype(np.int64)
                some = some[odd * (100 + percent) <= (n + m[some]) * (100 - percent)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), left["node"][row])), pa.array(right["node"][some])], ["a", "b"])

    return settle(dealt.mapInArrow(run, "a long, b long").distinct(), "across-pairs")
