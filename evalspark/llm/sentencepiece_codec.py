"""SentencePiece encoding with source offsets, and decoding.

A text is normalised here, not in the library: at each place the longest prefix that the model's compiled character map
knows is replaced, and every byte of the result remembers the source byte it came from. The normalised text is cut where
no piece of the vocabulary can reach across, each part is encoded once per worker by the library (with normalisation
turned off) and kept, and the pieces are projected to spans of source bytes through the alignment.

Nulls and empty texts have no pieces and decode to an empty text. Repeated rows are encoded one by one. Other columns
are passed on, but for those that have the name of a result: the result takes their place.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import PartStore, slices, tidy

MARK = "▁"
_MARK = MARK.encode()
#: Parts kept per worker process.
KEPT_PARTS = 150_000
#: Bytes of text encoded at a time, and texts decoded at a time.
SLICE = 500_000
DECODED = 200
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protobuf message."""
    place = 0

    def varint() -> int:
        nonlocal place
        value = shift = 0
        while True:
            byte = data[place]
            place += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while place < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, wire, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, wire, data[place : place + size]
            place += size


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and a pool of their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, begin: int) -> tuple[int, int] | None:
        """(length, place in the pool) of the longest known prefix of ``data[begin:]``."""
        if not self.units:
            return None
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= unit >> 10 << ((unit & 512) >> 6)
        for length in range(1, len(data) - begin + 1):
            byte = data[begin + length - 1]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            # The label of a unit holds bit 31 too: a leaf's value never equals a byte.
            if unit & (1 << 31 | 255) != byte:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (length, units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, place: int) -> bytes:
        return self.pool[place : self.pool.index(b"\0", place)]


class Model:
    """What encoding needs of a model file."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.pieces: list[tuple[str, int]] = []
        spec, rest = b"", []
        for number, wire, value in _fields(proto):
            if number == 1:
                fields = {n: v for n, _, v in _fields(value)}
                self.pieces.append((fields[1].decode(), fields.get(3, _NORMAL)))
            elif number == 3:
                spec = value
            if number != 3:
                body = _varint(len(value)) + value if wire == 2 else value if wire in (1, 5) else _varint(value)
                rest.append(_varint(number << 3 | wire) + body)
        settings = {n: v for n, _, v in _fields(spec)}
        self.map = CharacterMap(settings.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(settings.get(n, 1)) for n in (3, 4, 5))
        trainer = next((dict((n, v) for n, _, v in _fields(f[2])) for f in _fields(proto) if f[0] == 2), {})
        self.byte_fallback, self.suffix = bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        # Identity, no dummy prefix, no trimming: the library gets texts that are normalised already.
        plain = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28" + bytes([self.escape])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + _varint(len(plain)) + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.lengths = np.array([1 if kind == _BYTE else len(p.encode()) for p, kind in self.pieces], dtype=np.int32)
        self.user_defined = sorted((p.encode() for p, kind in self.pieces if kind == _USER_DEFINED), key=len, reverse=True)
        self.parts = self._parts()
        self.store = PartStore(lambda parts: self.bare.encode(parts, num_threads=1), KEPT_PARTS)

    def _parts(self) -> re.Pattern | None:
        """How normalised text may be cut: before a mark that no piece has after another character, around line feeds
        that no piece joins to anything. None if pieces reach across, or unknown runs would be joined."""
        normal = [p for p, kind in self.pieces if kind in (_NORMAL, _USER_DEFINED)]
        if not self.byte_fallback or any(re.search(f"[^{MARK}]{MARK}", p) for p in normal) or any("\n" in p and p.strip("\n") for p in normal):
            return None
        return re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it stems from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        if not self.map.units and not self.trim and self.escape and not self.user_defined:
            # Nothing but spaces changes: each becomes a mark of three bytes.
            prefix, suffix = (MARK, "") if self.dummy_prefix and not self.suffix else ("", MARK if self.dummy_prefix else "")
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1))
            edge = 3 * bool(prefix), 3 * bool(suffix) + 1
            return prefix + text.replace(" ", MARK) + suffix, np.concatenate((np.zeros(edge[0], np.int32), align, np.full(edge[1], len(raw), np.int32)))
        return self._normalise(data)

    def _prefix(self, data: bytes, begin: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix and its length; a character on its own stays."""
        for piece in self.user_defined:
            if data.startswith(piece, begin):
                return piece, len(piece)
        found = self.map.longest(data, begin)
        if found:
            return self.map.replacement(found[1]), found[0]
        lead = data[begin]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[begin : begin + length], length

    def _normalise(self, data: bytes) -> tuple[str, np.ndarray]:
        out, align, place = bytearray(), [], 0
        space = _MARK if self.escape else b" "
        if self.trim:
            while place < len(data):
                found, length = self._prefix(data, place)
                if found != b" ":
                    break
                place += length
            if place == len(data):
                return "", np.zeros(1, np.int32)
        if self.dummy_prefix and not self.suffix:
            out += space
            align += [place] * len(space)
        after_space = self.trim
        while place < len(data):
            found, length = self._prefix(data, place)
            if after_space:
                found = found.lstrip(b" ")
            for byte in found:
                put = space if byte == 32 else bytes([byte])
                out += put
                align += [place] * len(put)
            if found:
                after_space = found.endswith(b" ")
            place += length
            after_space = after_space and self.trim
        if self.trim:
            while out.endswith(space):
                place = align[len(out) - len(space)]
                del out[len(out) - len(space) :], align[len(out) :]
        if self.dummy_prefix and self.suffix:
            out += space
            align += [place] * len(space)
        return out.decode(), np.array([*align, place], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the source bytes at which pieces begin and end, and the number of ids per text."""
        normal = [self.normalise(t) for t in texts]
        if self.parts is None:
            # Pieces may reach across any cut: whole texts, and the library's ends of pieces.
            found = [self.bare.encode(n, return_type="proto").pieces if n else [] for n, _ in normal]
            ids = np.array([p.id for f in found for p in f], np.int32)
            counts = np.array([len(f) for f in found], np.int64)
            lengths = np.array([p.end - p.begin for f in found for p in f], np.int64)
        else:
            parts = [self.parts.findall(n) for n, _ in normal]
            ids, sizes = self.store.ids(list(chain.from_iterable(parts)))
            edges = np.cumsum([0, *map(len, parts)])
            before = np.concatenate(([0], np.cumsum(sizes)))
            counts = before[edges[1:]] - before[edges[:-1]]
            lengths = self.lengths[ids].astype(np.int64)
        # Alignments stand in a row too; a text has one entry more than bytes, for its end.
        base = np.cumsum([0, *(len(a) for _, a in normal)])
        align = np.concatenate([a for _, a in normal]) if normal else np.zeros(0, np.int32)
        first = np.cumsum(counts) - counts
        ends = np.cumsum(lengths)
        shift = base[:-1] - np.concatenate(([0], ends))[first]
        shift = np.repeat(shift, counts)
        whole = np.concatenate(([0], ends))[first + counts] - np.concatenate(([0], ends))[first]
        if (whole != np.array([len(a) - 1 for _, a in normal])).any():
            raise ValueError("pieces do not add up to the normalised text")
        return ids, align[ends - lengths + shift], align[ends + shift], counts


@lru_cache(maxsize=2)
def load(proto: bytes) -> Model:
    return Model(proto)


SPANS = ("ids", "begins", "ends")


def _with_results(df: DataFrame, source: str, run, results: list[tuple[str, T.DataType]]) -> DataFrame:
    """The columns of ``df`` and those that ``run`` makes of ``source``; results replace columns of their name.

    ``run`` turns a batch into (batch without ``source``, arrays of the results).
    """
    names = [n for n, _ in results]
    kept = [c for c in df.columns if c not in names]
    given = "_source"
    while given in kept:
        given += "_"
    kinds = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, k) for n, k in results)])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arrays in run(batches, given):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], [*kept, *names])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(given)).mapInArrow(tidy(tasks), kinds)


def _decoded(decoder, ids: list[list[int]]) -> Iterator[str]:
    return (decoder.decode(i) if i else "" for i in ids)


def encode(docs: DataFrame, model: bytes, text: str = "text", decoded: str | None = None, round_trip: str | None = None) -> DataFrame:
    """Adds ``ids``, ``begins`` and ``ends``: piece ids and their spans in bytes of the source text.

    ``decoded`` names a column for the text of the ids, decoded in the same pass; ``round_trip`` one that tells whether
    it equals the source (null: empty).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], given: str) -> Iterator[tuple]:
        encoder = load(held.value)
        for batch in slices(batches, given, SLICE):
            texts = [t or "" for t in batch.column(given).to_pylist()]
            *flat, counts = encoder.encode(texts)
            edges = np.concatenate(([0], np.cumsum(counts)))
            arrays = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(f, pa.int32())) for f in flat]
            if decoded or round_trip:
                back = list(_decoded(encoder.whole, [flat[0][a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]))
                arrays += [pa.array(back, pa.string())] * bool(decoded)
                arrays += [pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())] * bool(round_trip)
            yield batch, arrays

    results = [(n, T.ArrayType(T.IntegerType())) for n in SPANS]
    results += [(decoded, T.StringType())] * bool(decoded) + [(round_trip, T.BooleanType())] * bool(round_trip)
    return _with_results(docs, text, run, results)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids decode to an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], given: str) -> Iterator[tuple]:
        decoder = load(held.value).whole
        for batch in batches:
            for begin in range(0, batch.num_rows, DECODED):
                part = batch.slice(begin, DECODED)
                yield part, [pa.array(list(_decoded(decoder, part.column(given).to_pylist())), pa.string())]

    return _with_results(rows, ids, run, [(out, T.StringType())])
