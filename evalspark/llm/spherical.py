"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A code turns the space by a random rotation, splits it into blocks and has random unit vectors for each block; every
combination of one vector per block is a filter direction, 65,536 with two blocks of 256. Vectors of fewer than ten
components have one block of 4,096. The number of directions follows the number of vectors that are compared with each
other (``grade_of``), with more vectors per block and then more blocks, so that a filter holds about as many unlike vectors
whatever the size of the table; the threshold follows the number of directions. A vector is list-decoded to all directions whose inner product exceeds a threshold
that follows from the cosine and the width: two vectors at that cosine are to have six common filters of each code on
average. A vector with fewer than eight directions above it is listed at its best eight. Sums of blocks that cannot reach
the threshold are not continued, so directions are not all looked at. Vectors with a common filter meet, and every
meeting pair is verified by its cosine in double precision. Where filters would compare as many pairs as there are (few
components or a low cosine), there is one filter for all, and no pair is missed; README has the miss rates by width.

Pairs are not listed. A filter's vectors are compared in tiles, as matrix products inside a task, which give counts of
links and a spanning forest of the tile; filters of a few vectors are compared many at a time. A pair is counted in the
first filter that it has in common.

Nulls: a vector that is null, zero, or holds null or non-finite components links with nothing; so does one without a
label or without an id. Only vectors of one label and one length are compared. Rows with one vec_id are one vector (the
least label and embedding count). Columns other than the named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import matrix
from evalspark.llm.components import components
from evalspark.plans.shared import settle

CODES = 4
#: Blocks have up to 2 ** BLOCK_BITS directions each, and there are two at least.
BLOCK_BITS = 10
#: Vectors with fewer components are not split into blocks.
NARROW = 10
#: Directions of a code for each vector of a label, at least.
DIRECTIONS_PER_ROW = 64
#: Filters of a code that two vectors at the cosine share on average.
COMMON = 6
#: Filters of a code that a vector has at the least.
LISTED = 8
#: Share of all pairs that the filters of unlike vectors may compare; beyond it there is one filter for all.
MOST_COMPARED = 0.5
#: Vectors on one side of a comparison within a filter.
TILE = 1024
#: Filters of up to so many vectors are compared together, in chunks of about so many rows.
FEW, CHUNK = 64, 20_000


def bits_of(width: int, grade: int = 0) -> int:
    """Logarithm of the number of directions.

    It ends where blocks would have too few components to be told apart by random directions: at 16 bits for one block,
    at 18 for two blocks of five to seven components, and with as many blocks of eight components as the width has.
    """
    if width < NARROW:
        return min(12 + 2 * grade, 16)
    return min(16 + 2 * grade, 18 if width < 16 else BLOCK_BITS * max(2, width // 8))


def grade_of(rows: Column) -> Column:
    """How many times the directions of a code are made four times as many for ``rows`` vectors of a label and width."""
    wanted = F.log2(F.lit(float(DIRECTIONS_PER_ROW)) * rows) - 16
    return F.greatest(F.ceil(wanted / 2), F.lit(0)).cast("int")


@lru_cache(maxsize=64)
def code(width: int, number: int, grade: int = 0) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """A rotation, and (begin, end, unit vectors) of each block."""
    rng = np.random.default_rng([width, number, grade] if grade else [width, number])
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    bits = bits_of(width, grade)
    blocks = -(-bits // BLOCK_BITS) if width >= NARROW else 1
    number_of = math.ceil(2 ** (bits / blocks))
    edges = [width * k // blocks for k in range(blocks + 1)]
    out = []
    for begin, end in zip(edges, edges[1:], strict=False):
        vectors = rng.normal(size=(number_of, end - begin))
        out.append((begin, end, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)))
    return turn, out


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def share_above(height: float, width: int, cosine: float) -> float:
    """Share of all directions whose inner products with both of two unit vectors at ``cosine`` exceed ``height`` >= 0."""
    half = np.arccos(min(1.0, cosine)) / 2
    steps = 20_000
    turn = (np.arange(steps) + 0.5) / steps * (np.pi / 2 - half)
    # A direction's part in the plane of the two has the length r with P(r > s) = (1 - s^2)^((width - 2) / 2).
    left = 1 - (height / np.cos(turn + half)) ** 2
    return float(np.where(left > 0, np.maximum(left, 1e-300) ** ((width - 2) / 2), 0).mean() * (np.pi / 2 - half) / np.pi)


@lru_cache(maxsize=64)
def threshold(width: int, cosine: float, grade: int = 0) -> float | None:
    """Inner product with a unit direction beyond which a vector has its filter; None: one filter for all."""
    number = 1 << bits_of(width, grade)
    if width < 2 or cosine <= 0 or number * share_above(0.0, width, cosine) < COMMON:
        return None
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if number * share_above(middle, width, cosine) >= COMMON else (low, middle)
    return low if CODES * number * share_above(low, width, 1.0) ** 2 < MOST_COMPARED else None


def decode(vectors: np.ndarray, cosine: float = 0.98, grade: int = 0) -> np.ndarray:
    """Filters of each unit vector, the best of every code first; -1 fills the rows."""
    height = threshold(vectors.shape[1], cosine, grade)
    if height is None:
        return np.zeros((len(vectors), 1), np.int64)
    out = []
    for number in range(CODES):
        turn, blocks = code(vectors.shape[1], number, grade)
        turned = vectors @ turn
        inner = [turned[:, begin:end] @ directions.T for begin, end, directions in blocks]
        # The best sums need only the best partial sums and the best directions of the next block.
        best = np.zeros((len(vectors), 1))
        for part in inner:
            top = -np.sort(np.partition(-part, LISTED - 1, axis=1)[:, :LISTED], axis=1)
            wide = best[:, :, None] + top[:, None, :]
            best = np.sort(wide.reshape(len(vectors), -1), axis=1)[:, ::-1][:, :LISTED]
        floor = np.minimum(height * np.sqrt(len(blocks)), best[:, -1]) - 1e-9
        rows, names, sums = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for k, part in enumerate(inner):
            rest = sum((later.max(axis=1) for later in inner[k + 1 :]), np.zeros(len(vectors)))
            wide = sums[:, None] + part[rows]
            at, pick = np.nonzero(wide >= (floor - rest)[rows][:, None])
            rows, names, sums = rows[at], names[at] * part.shape[1] + pick, wide[at, pick]
        order = np.lexsort((-sums, rows))
        rows, names = rows[order], names[order]
        sizes = np.bincount(rows, minlength=len(vectors))
        filled = np.full((len(vectors), sizes.max(initial=0)), -1)
        filled[rows, np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]] = names + number * math.prod(p.shape[1] for p in inner)
        out.append(filled)
    return np.concatenate(out, axis=1)


def usable(embedding: Column, label: Column) -> Column:
    """Finite, not zero, labelled."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def filtered(vectors: DataFrame, cosine: float) -> DataFrame:
    """Usable vectors with their width and filters."""
    kind = vectors.schema["embedding"].dataType
    rows = vectors.filter(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id"))
    rows = rows.agg(F.min(F.struct("label", "embedding")).alias("_v")).select("vec_id", "_v.label", "_v.embedding")
    rows = settle(rows.filter(usable(F.col("embedding"), F.col("label"))).withColumn("width", F.size("embedding")), "usable-vectors")
    # One row per label and width.
    grades = rows.groupBy(F.col("label").alias("_label"), F.col("width").alias("_width")).agg(grade_of(F.count("*")).alias("grade"))
    grades = settle(grades, "vector-grades")
    rows = rows.join(grades, (F.col("label") == F.col("_label")) & (F.col("width") == F.col("_width"))).select(*rows.columns, "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("width").to_numpy() * 64 + batch.column("grade").to_numpy()
            for kind in np.unique(kinds):
                part = batch.filter(pa.array(kinds == kind)).drop_columns(["grade"])
                width, grade = divmod(int(kind), 64)
                for begin in range(0, part.num_rows, 500):
                    piece = part.slice(begin, 500)
                    flat = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    filters = decode(unit(flat), cosine, grade)
                    lists = pa.array([np.sort(row[row >= 0]) for row in filters], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*piece.schema.names, "filters"])

    label = vectors.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, embedding {kind.simpleString()}, width int, filters array<long>")


def _met_before(lists: pa.ChunkedArray, left: np.ndarray, right: np.ndarray, name: int) -> np.ndarray:
    """Whether the rows ``left`` of ``lists`` share a filter below ``name`` with the rows ``right``, as a matrix."""
    lists = lists.combine_chunks()
    owners, filters = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    sides = []
    for rows in (left, right):
        place = np.full(len(lists), -1)
        place[rows] = np.arange(len(rows))
        keep = (filters < name) & (place[owners] >= 0)
        sides.append((place[owners[keep]], filters[keep]))
    shared = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), bool)
    for begin in range(0, len(shared), 4096):
        some, marks = shared[begin : begin + 4096], []
        for rows, (place, filters) in zip((left, right), sides, strict=True):
            keep = np.isin(filters, some)
            marks.append(np.zeros((len(rows), len(some)), np.float32))
            marks[-1][place[keep], np.searchsorted(some, filters[keep])] = 1
        out |= marks[0] @ marks[1].T > 0
    return out


def _forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric boolean matrix, the least id of its component."""
    names = ids.copy()
    while True:
        best = np.where(linked, names[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(names, best)
        if (new == names).all():
            return names
        names = new


def compare(group: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links within one pair of tiles: ``vec_id, links`` (those counted here) and ``other``, the root in its forest."""
    ids, tile = group.column("vec_id").to_numpy(), group.column("tile").to_numpy()
    width, name = group.column("width")[0].as_py(), group.column("filter")[0].as_py()
    vectors = unit(matrix(group.column("embedding"), width, np.float64))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    near = vectors[left] @ vectors[right].T >= cosine
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    if not len(a):
        return None
    a, b = left[a], right[b]
    # A pair is counted in the first of its common filters.
    (rows, at), (columns, under) = (np.unique(ends, return_inverse=True) for ends in (a, b))
    mine = ~_met_before(group.column("filters"), rows, columns, name)[at, under]
    counts = np.bincount(a[mine], minlength=len(ids)) + np.bincount(b[mine], minlength=len(ids))
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[a, b] = linked[b, a] = True
    some = np.flatnonzero(linked.any(axis=1))
    roots = _forest(linked[np.ix_(some, some)], ids[some])
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some].astype(np.int64)), pa.array(roots)], ["vec_id", "links", "other"])


def _first_met(filters: pa.ListArray, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether ``names`` are the first filters that the rows ``left`` and ``right`` share, pair by pair."""
    edges, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
    flat, edges = flat[edges[0] : edges[-1]], edges - edges[0]
    base = int(flat.max()) + 1
    keys = np.repeat(np.arange(len(filters)), np.diff(edges)) * base + flat  # ascending, as lists are
    out = np.ones(len(left), bool)
    for begin in range(0, len(left), 50_000):
        a, b, name = (x[begin : begin + 50_000] for x in (left, right, names))
        sizes = (edges[1:] - edges[:-1])[a]
        pair = np.repeat(np.arange(len(a)), sizes)
        spots = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edges[:-1][a][pair]
        keep = flat[spots] < name[pair]
        pair, wanted = pair[keep], (b[pair] * base + flat[spots])[keep]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out[begin + pair[keys[at] == wanted]] = False
    return out


def compare_few(table: pa.Table, begins: np.ndarray, size: int, cosine: float) -> pa.RecordBatch | None:
    """``compare`` for many filters of ``size`` vectors and one width each; ``begins`` are their first rows in the table."""
    rows = begins[:, None] + np.arange(size)
    ids, width = table.column("vec_id").to_numpy(), table.column("width")[int(begins[0])].as_py()
    part = table.take(pa.array(rows.ravel()))
    x = unit(matrix(part.column("embedding"), width, np.float64)).reshape(len(begins), size, width)
    near = x @ x.transpose(0, 2, 1) >= cosine
    near[:, np.arange(size), np.arange(size)] = False
    some = np.flatnonzero(near.any(axis=(1, 2)))
    if not len(some):
        return None
    near, rows = near[some], rows[some]
    group, a, b = np.nonzero(np.triu(near))
    names = table.column("filter").to_numpy()[rows[group, a]]
    mine = _first_met(table.column("filters").combine_chunks(), rows[group, a], rows[group, b], names)
    at = np.concatenate((group * size + a, group * size + b))
    counts = np.bincount(at, np.concatenate((mine, mine)), minlength=len(some) * size).astype(np.int64).reshape(len(some), size)
    roots = ids[rows]
    while True:
        best = np.minimum(roots, np.where(near, roots[:, None, :], np.iinfo(np.int64).max).min(axis=2))
        if (best == roots).all():
            break
        roots = best
    linked = near.any(axis=2)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows][linked]), pa.array(counts[linked]), pa.array(roots[linked])], ["vec_id", "links", "other"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows from a partition sorted by ``keys``, which cut no group, and where groups begin."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < rows:
                continue
        if held is None or not held.num_rows:
            return
        change = np.zeros(held.num_rows, bool)
        for key in keys:
            column = held.column(key).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        change[0] = True
        begins = np.flatnonzero(change)
        if batch is None:
            yield held.combine_chunks(), np.append(begins, held.num_rows)
            return
        if len(begins) > 1:
            yield held.slice(0, begins[-1]).combine_chunks(), begins
            held = held.slice(begins[-1]).combine_chunks()
        rows = max(rows, 2 * held.num_rows)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``."""
    rows = settle(filtered(vectors.select("vec_id", "embedding", "label"), cosine), "filtered-vectors")
    key = ["label", "width", "filter"]
    listed = rows.select("vec_id", "label", "width", F.explode("filters").alias("filter"))
    sizes = listed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    sizes = settle(sizes.select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "filter-sizes")
    members = rows.withColumn("filter", F.explode("filters")).join(sizes, key)
    tile = F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")
    members = members.withColumn("tile", tile).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.select(
        "vec_id", *key, "embedding", "filters", "tiles", "tile", F.least("tile", "_other").alias("i"), F.greatest("tile", "_other").alias("j")
    )
    dealt = members.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, [*key, "i", "j"], CHUNK):
            sizes, widths = np.diff(begins), table.column("width").to_numpy()
            alone = table.column("tiles").to_numpy()[begins[:-1]] == 1
            for group in np.flatnonzero((sizes > 1) & ~(alone & (sizes <= FEW))):
                if (found := compare(table.slice(begins[group], sizes[group]), cosine)) is not None:
                    yield found
            kinds = np.where(alone & (sizes > 1) & (sizes <= FEW), widths[begins[:-1]] * (FEW + 1) + sizes, -1)
            for kind in np.unique(kinds[kinds >= 0]):
                width, size = divmod(int(kind), FEW + 1)
                step = max(1, 2_000_000 // (size * max(width, size)))
                same = begins[:-1][kinds == kind]
                for begin in range(0, len(same), step):
                    if (found := compare_few(table, same[begin : begin + step], size, cosine)) is not None:
                        yield found

    links = settle(dealt.mapInArrow(run, "vec_id long, links long, other long"), "vector-links")
    found = settle(components(links.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))), "components")
    counts = settle(links.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("n_links")).join(found, "node", "left"), "link-counts")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(counts, F.col("vec_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
