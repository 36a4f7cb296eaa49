"""Token files: ids packed by an adaptive context-mixing range coder in independent, checksummed blocks.

A file is a table of frames in ascending doc_id order. A frame holds whole documents: their ids, how many tokens each
has, its distinct token ids by falling frequency (``words``), and blocks of up to 2,048 token ids, each with its length, the
crc32 of its ids and its bytes. Blocks code the ranks of ids in ``words``. Every block starts from the same model, so with
``words`` it can be read, checked and recovered alone.

Three predictions of an id are mixed into one distribution. Order 2 (the two ids before) and order 1 (the id before) each
name the id that they saw last and how sure they are of it. Order 0 gives a chance to every id: shares of 16 classes of
ranks (0 and 1, 2 and 3, 4 to 7, and so on; 32 classes if ranks need more than 16 bits), even within a class, as ranks
follow frequency. The weights of the three orders, for each sureness of orders 1 and 2, and the shares of the classes are learned on
the way, and one step of the range coder codes an id (a second one the last 16 bits of larger ranks). A block's first byte
tells how many hex digits its ranks need beyond four. All arithmetic is on integers. Blocks are coded side by side, one lane
of numpy arrays each.

Nulls: a null text is empty and has only the end id. A null doc_id comes first. Rows with equal doc_id stand side by
side, ordered by their texts. An empty table writes no frames. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import PartStore, Places, load_tokenizer, slices, tidy
from evalspark.plans.shared import settle

BLOCK = 2048
#: Ids after which a frame is closed, at the end of a document.
FRAME = 8 << 20
KEPT_PARTS = 800_000
SLICE = 4_000_000
_ONE, _TWO = 512, 2048  # entries of the order-1 and order-2 tables

FRAMES = "part int, number int, doc_ids array<long>, counts array<int>, words array<int>, lengths array<int>, crcs array<long>, blocks array<binary>"


class _Coder:
    """Range coders side by side, of 64 bits, that give out up to three units of 16 bits after a step.

    Writing keeps what each step adds to a lane's number and at which unit; the numbers are summed, with carries, at the end.
    """

    def __init__(self, lanes: int, data: np.ndarray | None, longest: int):
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.place = np.zeros(lanes, np.int64)
        self.reading = data is not None
        if self.reading:
            # Four units from each place on, as one value; behind the end of a block there are zeros.
            units = np.pad(data, ((0, 0), (0, 7))).astype(np.uint64)
            self.width = units.shape[1] - 3
            sight = units[:, : self.width].copy()
            for k in range(1, 4):
                sight <<= _UNIT
                sight |= units[:, k : k + self.width]
            self.data = sight.ravel()
            self.place += np.arange(lanes) * self.width
            self.code = self._next(lanes)
            self.place += 4
        else:
            self.count = 0
            self.added = np.zeros((2 * longest, lanes), np.uint64)
            self.places = np.zeros((2 * longest, lanes), np.uint16)

    def _next(self, lanes: int) -> np.ndarray:
        # A damaged block may ask for more than there is.
        return self.data.take(self.place[:lanes], mode="clip")

    def step(self, below: np.ndarray, share: np.ndarray) -> None:
        """Narrow the first lanes to the part of their ranges that begins at ``below`` and is ``share`` long."""
        lanes = len(below)
        place = self.place[:lanes]
        units = (share < _RANGES[0]).view(np.uint8)
        if share.min() < _RANGES[1]:
            units = units + (share < _RANGES[1]).view(np.uint8) + (share < _RANGES[2]).view(np.uint8)
        bits = (units << np.uint8(4)).astype(np.uint64)
        if self.reading:
            code = self.code[:lanes] - below << bits
            code |= self._next(lanes) >> np.uint64(64) - bits
            self.code[:lanes] = code
        else:
            self.added[self.count, :lanes], self.places[self.count, :lanes] = below, place
            self.count += 1
        np.left_shift(share, bits, out=self.range[:lanes])
        place += units

    def finish(self) -> list[bytes]:
        """The bytes of each lane's number, rounded up to the unit after the last one given out."""
        out: list[bytes] = []
        for begin in range(0, len(self.place), _LANES):
            part = slice(begin, begin + _LANES)
            ends = self.place[part]
            room = int(ends.max()) + 4
            begins = np.arange(len(ends)) * room
            at = (self.places[: self.count, part] + begins).ravel()
            values = self.added[: self.count, part].ravel()
            # 32 bits at a time; what exceeds 16 is carried to the unit before.
            sums = np.bincount(at + 1, values >> _HALF, len(ends) * room).astype(np.int64)
            sums += np.bincount(at + 3, values & _LOWER, len(ends) * room).astype(np.int64)
            # The last step of a lane has a range of a unit at least, so the next whole unit lies in it.
            for k in range(1, 4):
                sums[begins + ends + k] += 0xFFFF
            rows = sums.reshape(len(ends), room)
            while (carry := rows >> 16).any():
                rows &= 0xFFFF
                rows[:, :-1] += carry[:, 1:]
            units = rows.astype(">u2")
            out.extend(units[k, : place + 1].tobytes() for k, place in enumerate(ends.tolist()))
        return out


_UNIT, _RANGES = np.uint64(16), (np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(1 << 16))
_HALF, _LOWER = np.uint64(32), np.uint64((1 << 32) - 1)
_LANES = 256  # whose numbers are summed at a time
_SCALE = 15  # bits of cumulative shares
#: Bits of a rank within its class (ranks 0 and 1, 2 and 3, 4 to 7, ...), coded after it, and the first rank of each class.
_BITS = np.maximum(np.arange(32), 1).astype(np.uint64)
_FLOOR = np.where(np.arange(32) > 0, 1 << np.arange(32), 0)
#: Cumulative shares of 16 or 32 classes that a table moves to when it has seen a class; every class keeps a share of 1.
_GOALS = {n: np.array([[i if i <= s else (1 << _SCALE) - n + i for i in range(n)] for s in range(n)], np.int16) for n in (16, 32)}
#: Two shares are read and written as one number. Where those of order 2, and of orders 2 and 1, move to when order 0, 1 or 2 was right.
_MIX = np.array([[64, 128], [64, 32704], [32640, 32704]], np.int16).view(np.uint32).ravel()
#: Both at first, by how sure order 2 and order 1 are, and whether their candidates are unlike or equal.
_FIRST = np.array([
    [32 + 6144 * s2, 96 + 6144 * s2 + (0 if same else 3072 * s1)] for s2 in range(4) for s1 in range(4) for same in (0, 1)
], np.int16).view(np.uint32).ravel()


def _classes(ranks: np.ndarray) -> np.ndarray:
    """Class of each rank: the number of its highest bit, 0 for rank 0."""
    return ((ranks | 1).astype(np.float64).view(np.int64) >> 52) - 1023


_SMALL = _classes(np.arange(1 << 16))


def _code(lengths: np.ndarray, ids: np.ndarray | None, data: np.ndarray | None, high: int) -> tuple[_Coder, np.ndarray]:
    """Code all lanes from a fresh model each; lengths descend. Reads ``data`` or writes ``ids`` (positions x lanes).

    ``high`` is above 0 if ids need more than 16 bits.
    """
    lanes, longest = len(lengths), int(lengths[0])
    coder = _Coder(lanes, data, longest)
    out = np.zeros((longest, lanes), np.int32) if ids is None else ids
    kind, classes = (np.int64, 32) if high else (np.int32, 16)
    # Ids seen last by context, with how sure they are (0, 2, 4 or 6): row 0 of what follows is order 1, row 1 order 2.
    every = np.arange(lanes, dtype=np.int64)
    first = np.stack((every * _ONE, lanes * _ONE + every * _TWO))
    seen = np.zeros(lanes * (_ONE + _TWO), kind)
    # The weights of the orders, by how sure orders 1 and 2 are; the classes of order 0, and a 0 behind them.
    weights = np.tile(_FIRST, lanes)
    begins, corners = (every * 32).astype(kind), every * classes
    flat = np.zeros(lanes * classes + 1, np.int16)
    tables = flat[:-1].reshape(lanes, classes)
    tables += (np.arange(classes) * ((1 << _SCALE) // classes)).astype(np.int16)
    goals, scale, top = _GOALS[classes], np.uint64(_SCALE), np.uint64((1 << _SCALE) - 1)
    older, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(longest):
        n = int(active[t])
        at = np.empty((2, n), np.int64)
        np.bitwise_and(last[:n], _ONE - 1, out=at[0])
        np.bitwise_xor(last[:n], older[:n], out=at[1])
        at[1] &= _TWO - 1
        at += first[:, :n]
        np.multiply(last[:n], 203, out=older[:n])
        held = seen.take(at)
        guess, sure = held >> 3, held & 6
        spots = sure[1] << 2
        spots += sure[0]
        spots += begins[:n]
        spots += guess[0] == guess[1]
        spots = spots.astype(np.int64)
        pairs = weights.take(spots)
        both = pairs.astype(np.uint64)
        whole = coder.range[:n]
        unit = whole >> scale
        # Ends of the parts of order 2 and of order 1.
        second, third = both & np.uint64(0xFFFF), both >> _UNIT
        second *= unit
        third *= unit
        unit = whole - third
        unit >>= scale
        rows = tables[:n]
        if ids is None:
            code = coder.code[:n]
            right, missed = code < second, code >= third
            code = code - third
            found = code // unit
            found &= top
            # Beside each share, four times in a number.
            found *= np.uint64(0x0001000100010001)
            beside = np.empty((n, classes // 4), np.uint64)
            for k in range(classes // 4):
                beside[:, k] = found
            passed = np.bitwise_count((rows <= beside.view(np.int16)).view(np.uint64))
            kinds = passed[:, 0] + passed[:, 1] if classes == 16 else passed.sum(axis=1)
            kinds = kinds.astype(np.int64)
            kinds -= 1
        else:
            symbol = out[t, :n].astype(np.int64)
            right = guess[1] == symbol
            missed = ~(right | (guess[0] == symbol))
            kinds = _classes(symbol) if high else _SMALL.take(symbol)
        spot = corners[:n] + kinds
        below = flat.take(spot)
        spot += 1
        # Every row begins with 0, so behind its last class stands 0: the whole scale, where numbers are taken modulo it.
        share = flat.take(spot) - below
        share &= np.int16((1 << _SCALE) - 1)
        below = below.astype(np.uint64)
        below *= unit
        unit *= share.astype(np.uint64)
        bits = _BITS.take(kinds)
        # Ranks of more than 16 bits have their last 16 in a step of their own.
        more = bits > _UNIT if high else None
        if high:
            bits = np.where(more, bits - _UNIT, bits)
        unit >>= bits
        if ids is None:
            code -= below
            place = code // unit
            place &= np.uint64(0xFFFF)  # more in damaged blocks only
        else:
            place = symbol - _FLOOR.take(kinds)
            if high:
                place = np.where(more, place >> 16, place)
            place = place.view(np.uint64)
        below += place * unit
        below += third
        third -= second
        share = np.where(right, second, third)
        second[right] = 0
        coder.step(np.where(missed, below, second), np.where(missed, unit, share))
        if high and (more := more & missed).any():
            unit = np.where(more, coder.range[:n] >> _UNIT, coder.range[:n])
            if ids is None:
                low = np.where(more, np.minimum(coder.code[:n] // unit, np.uint64(0xFFFF)), np.uint64(0))
                place = np.where(more, place << _UNIT | low, place) & np.uint64((1 << 31) - 1)
            else:
                low = np.where(more, symbol & 0xFFFF, 0).astype(np.uint64)
            coder.step(low * unit, unit)
        if ids is None:
            symbol = place.view(np.int64) + _FLOOR.take(kinds)
            np.copyto(symbol, guess[0], where=~missed)
            np.copyto(symbol, guess[1], where=right)
            out[t, :n] = symbol
            kinds = _classes(symbol) if high else _SMALL.take(symbol)
        # All that was used learns.
        step = goals.take(kinds, axis=0)
        step -= rows
        step >>= 5
        rows += step
        order = right.view(np.int8) - missed.view(np.int8)
        order += 1
        step, pairs = _MIX.take(order).view(np.int16), pairs.view(np.int16)
        step -= pairs
        step >>= 5
        step += pairs
        weights[spots] = step.view(np.uint32)
        small = symbol.astype(kind)
        np.minimum(sure, 4, out=sure)
        sure *= guess == small
        small <<= 3
        small += 2
        sure += small
        seen[at] = sure
        last[:n] = symbol
    return coder, out


def by_frequency(ids: np.ndarray) -> np.ndarray:
    """The distinct ids, the most frequent first."""
    distinct, counts = np.unique(ids, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")]


def pack(ids: np.ndarray, words: np.ndarray | None = None) -> tuple[list[int], list[int], list[bytes]]:
    """Lengths, checksums and bytes of the blocks of a row of ids; ``words`` are its distinct ids by rank, else an id is its rank."""
    if not len(ids):
        return [], [], []
    if ids.min() < 0 or ids.max() >= 1 << 31:
        raise ValueError("ids must be below 2 ** 31")
    ranks = ids
    if words is not None:
        if (size := int(words.max()) + 1) <= 1 << 22:
            places = np.zeros(size, np.int32)
            places[words] = np.arange(len(words))
            ranks = places[ids]
        else:
            order = np.argsort(words)
            ranks = order[np.searchsorted(words, ids, sorter=order)].astype(np.int32)
    high = -(-max(0, int(ranks.max()).bit_length() - 16) // 4)
    count = -(-len(ids) // BLOCK)
    lengths = np.full(count, BLOCK, np.int64)
    lengths[-1] = len(ids) - BLOCK * (count - 1)
    rows = np.zeros(count * BLOCK, np.int32)
    rows[: len(ids)] = ranks
    del ranks
    rows = np.ascontiguousarray(rows.reshape(count, BLOCK)[:, : int(lengths[0])].T)
    coder, _ = _code(lengths, rows, None, high)
    little = ids.astype("<u4")
    return lengths.tolist(), [zlib.crc32(little[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(count)], [bytes([high]) + block for block in coder.finish()]


def unpack(lengths: list[int], crcs: list[int], blocks: list[bytes], words: np.ndarray | None = None) -> np.ndarray:
    """The ids of any blocks in a row, packed with the same ``words``; raises if a checksum differs."""
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(blocks)
    for high in {block[0] for block in blocks}:
        some = [k for k, block in enumerate(blocks) if block[0] == high]
        if high > 4:
            raise ValueError(f"block {some[0]} is damaged")
        sizes = np.array([lengths[k] for k in some], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.zeros((len(some), max(len(blocks[k]) for k in some) // 2), np.uint16)
        for row, k in enumerate(order):
            block = blocks[some[k]][1:]
            if len(block) % 2:
                raise ValueError(f"block {some[k]} is damaged")
            data[row, : len(block) // 2] = np.frombuffer(block, ">u2")
        _, ranks = _code(sizes[order], None, data, high)
        ranks = np.ascontiguousarray(ranks.T)
        for row, k in enumerate(order):
            ids = ranks[row, : sizes[k]]
            if words is not None:
                ids = words.take(ids, mode="clip")
            ids = ids.astype("<u4")
            if zlib.crc32(ids.tobytes()) != crcs[some[k]]:
                raise ValueError(f"block {some[k]} is damaged")
            found[some[k]] = ids.astype(np.int32)
    return np.concatenate([np.zeros(0, np.int32), *found])


_PROBES = ("a", "The", "naïve", "日本", "12", "x9", "don't", "'s", "...", "(", "ﬁ", "<|", "é", "\u0301", "İ")


def cuts_at_white_space(tokenizer) -> bool:
    """Whether texts can be encoded word by word: no piece spans white space, and words do not depend on what is beside it.

    Pieces of several characters must hold no white space or mark of it, and probe words must give the same ids alone and
    side by side, whatever stands between them.
    """
    marks = re.compile(r"[\s\u0120\u010a\u0109\u010d\u2581]")  # as it is, as byte-level pieces write it, as a low line
    ending = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
    pieces = (p.removesuffix(ending) for p in tokenizer.get_vocab())
    if tokenizer.truncation or tokenizer.padding or any(len(p) > 1 and marks.search(p) for p in pieces):
        return False
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    alone = {p: ids(p) for p in _PROBES}
    return all(
        ids(gap.join(pair)) == alone[pair[0]] + alone[pair[1]]
        for gap in (" ", "  ", "\n", "\t", " \r\n", "\x0b", "\x0c") for pair in zip(_PROBES, (*_PROBES[1:], _PROBES[0]), strict=True)
    ) and not ids(" \n\t")


#: Normalizers and pre-tokenizers whose pieces of a plain text are known: the matches of one expression in lower case, as bytes.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Plain texts have no characters but these, which no normalizer composes: ASCII from 0x21, white space, Latin letters up to U+00FF.
_PLAIN = re.compile("[\x20\x09-\x0d!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\x20\x09-\x0da-zß-öø-ÿ0-9]+")
#: The letter by which byte-level pieces write each byte that is not visible in Latin-1.
_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: The same for all bytes; spaces, between pieces, stay.
_WRITTEN = np.array([b if b == 32 else _LETTERS.get(b, b) for b in range(256)], "<u2")
#: Of each character up to U+00FF its kind (white space, letter, digit, any other one in plain texts, none of them) and lower case.
_SPACE, _LETTER, _DIGIT, _OTHER, _NONE = range(5)


def _kind(c: str) -> int:
    if not _PLAIN.fullmatch(c):
        return _NONE
    return _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER


_KINDS = bytes(_kind(chr(b)) for b in range(256))
_LOWER_CASE = bytes(32 if kind == _SPACE else ord(chr(b).lower()) if kind == _LETTER else b for b, kind in enumerate(_KINDS))
_JOINED = 5000  # pieces that the library encodes in a row


def _starts(text: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces (``_PIECES``) of plain characters in lower case begin."""
    starts = kinds == _DIGIT
    starts[:1] = True
    starts[1:] |= kinds[1:] != kinds[:-1]
    # An apostrophe that begins a piece may begin one with the letters behind it.
    at = np.flatnonzero((text == ord("'")) & starts)
    if len(at):
        after = np.pad(text, (0, 3))
        one, two = after[at + 1], after[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for some, size in ((at[short], 2), (at[long], 3)):
            starts[some + 1] = False
            some = some[some + size < len(text)] + size
            starts[some] = True
    starts &= kinds != _SPACE
    return np.flatnonzero(starts)


class Parts:
    """Parts of texts that the tokenizer encodes one by one, and their ids; for tokenizers that pass ``cuts_at_white_space``.

    With the pre-tokenizer above, plain texts are cut into its pieces, and each piece goes to the library's model, many in a
    row: the library's own way to the model takes longer than the model itself. All else is cut into words, which go the
    library's way. Pieces of plain texts are Latin-1 bytes in what ``cut_all`` returns and ``encode`` takes.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.model = tokenizer, tokenizer.model
        made = json.loads(tokenizer.to_str())
        steps = [(made[k] or {}).get(name) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.known = steps == [_NORMALIZERS, _SPLITS] and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        # Added tokens are found in texts before anything else.
        self.added = [t["content"].lower() for t in made["added_tokens"]]
        # As they stand in plain texts, which have no others.
        self.marks = [a.encode("latin-1").translate(_LOWER_CASE) for a in self.added if all(c <= "ÿ" for c in a)]
        self.row = Tokenizer(self.model)
        self.row.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # The last token of a piece has a mark of its own.
        ending = made["model"].get("end_of_word_suffix")
        self.last = None
        if self.known and ending:
            words = made["model"]["vocab"]
            self.last = np.zeros(max(words.values()) + 1, bool)
            self.last[[k for w, k in words.items() if w.endswith(ending)]] = True

    def _plain(self, text: str) -> str | None:
        """A plain text in lower case."""
        if not (self.known and _PLAIN.fullmatch(text)):
            return None
        low = text.lower()
        return None if any(a in low for a in self.added) else low

    def cut(self, text: str) -> list[str]:
        low = self._plain(text)
        if low is not None:
            return _PIECES.findall(low)
        out: list[str] = []
        for word in text.encode().split():
            low = self._plain(word := word.decode())
            out.extend([word] if low is None else _PIECES.findall(low))
        return out

    def cut_all(self, texts: list[str]) -> tuple[list[bytes | str], np.ndarray, np.ndarray]:
        """The distinct parts of some texts, which of them follow each other in all texts in a row, and how many there are in each text."""
        plain = []
        for text in texts:
            try:
                plain.append(text.encode("latin-1") if self.known else None)
            except UnicodeEncodeError:
                plain.append(None)
        found, counts = self._cut_plain(plain)
        if None not in plain:
            found = found.dictionary_encode()
            return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), counts
        found, cuts, at = found.to_numpy(zero_copy_only=False).tolist(), [], 0
        for text, own, count in zip(texts, plain, counts.tolist(), strict=True):
            cuts.append(self.cut(text) if own is None else found[at : at + count])
            at += count
        places = Places()
        order = np.fromiter(map(places.__getitem__, chain.from_iterable(cuts)), np.int64)
        return list(places), order, np.array(list(map(len, cuts)), np.int64)

    def _cut_plain(self, texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
        """Pieces of the plain texts, and their numbers; texts that turn out not to be plain become None."""
        low = b"\n".join(t or b"" for t in texts).translate(_LOWER_CASE)
        kinds = low.translate(_KINDS)
        if _NONE in kinds or any(a in low for a in self.marks):
            for k, text in enumerate(texts):
                if text is not None and self._plain(text.decode("latin-1")) is None:
                    texts[k] = None
            low = b"\n".join(t or b"" for t in texts).translate(_LOWER_CASE)
            kinds = low.translate(_KINDS)
        kinds = np.frombuffer(kinds, np.uint8)
        starts = _starts(np.frombuffer(low, np.uint8), kinds)
        # Without white space, pieces stand side by side.
        dense = low.translate(None, b" ")
        edges = starts - np.cumsum(kinds == _SPACE, dtype=np.int32).take(starts)
        edges = np.append(edges, len(dense)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(dense)])
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        return pieces, np.diff(np.searchsorted(starts, ends), prepend=0)

    def encode(self, parts: list[bytes | str]) -> list[list[int]]:
        plain = [isinstance(p, bytes) or self._plain(p) is not None for p in parts]
        found = self._encode_plain([p if isinstance(p, bytes) else p.encode("latin-1") for p, known in zip(parts, plain, strict=True) if known])
        if all(plain):
            return list(found)
        others = [p for p, known in zip(parts, plain, strict=True) if not known]
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [next(found) if known else next(rest).ids for known in plain]

    def _encode_plain(self, pieces: list[bytes]) -> Iterator[list[int]]:
        for begin in range(0, len(pieces), _JOINED):
            some = pieces[begin : begin + _JOINED]
            row = _WRITTEN.take(np.frombuffer(b" ".join(some).decode("latin-1").encode(), np.uint8)).tobytes().decode("utf-16-le")
            ids = self.row.encode_batch_fast([row], add_special_tokens=False)[0].ids if self.last is not None else []
            ends = np.flatnonzero(self.last.take(ids)) + 1 if ids else []
            if len(ends) == len(some) and ends[-1] == len(ids):
                yield from (ids[a:b] for a, b in pairwise([0, *ends.tolist()]))
            else:
                yield from ([t.id for t in self.model.tokenize(piece)] for piece in row.split(" "))


@lru_cache(maxsize=1)
def _kept(content: str) -> tuple[Parts, PartStore, bool]:
    """A tokenizer's parts and their ids, kept in the worker process from task to task, and whether texts may be cut."""
    tokenizer = load_tokenizer(content, False)
    parts = Parts(tokenizer)
    return parts, PartStore(parts.encode, KEPT_PARTS), cuts_at_white_space(tokenizer)


def write(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, frame_ids: int = FRAME) -> None:
    """Tokenise whole texts, append ``end_id`` to each, and write frames in ascending doc_id order.

    Texts are cut at white space if the tokenizer drops it and no token spans it (``cuts_at_white_space``), and parts seen
    before (``Parts``) are not encoded again; else whole texts are encoded.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parts, store, in_words = _kept(held.value)
        part, number, names, counts, flat, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def frame() -> pa.RecordBatch:
            ids = np.concatenate(flat)
            flat.clear()
            words = by_frequency(ids)
            lengths, crcs, blocks = pack(ids, words)
            row = {"part": part, "number": number, "doc_ids": names, "counts": counts, "words": words, "lengths": lengths, "crcs": crcs, "blocks": blocks}
            kinds = [
                pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                pa.list_(pa.int64()), pa.list_(pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if in_words:
                distinct, order, counted = parts.cut_all(texts)
                ids, sizes = store.ids(distinct, order)
                edges = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *counted])]
            else:
                found = [np.array(e.ids, np.int32) for e in parts.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                ids, edges = np.concatenate(found), np.cumsum([0, *map(len, found)])
            for name, begin, end in zip(batch.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                names.append(name)
                counts.append(end - begin + 1)
                flat.extend((ids[begin:end], np.array([end_id], np.int32)))
                total += counts[-1]
                if total >= frame_ids:
                    yield frame()
                    number, names, counts, flat, total = number + 1, [], [], [], 0
        if names:
            yield frame()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id", "text")
    ordered.mapInArrow(tidy(run), FRAMES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` from the frames at ``path``; ``start`` counts the ids of all documents before."""
    frames = spark.read.schema(FRAMES).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    sizes = frames.select("part", "number", size.alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))  # one row per written file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "number", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("_start")).join(parts, "part")
    starts = settle(starts.select("part", "number", (F.col("_start") + F.col("_part_start")).alias("start")), "frame-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                ids = unpack(get("lengths"), get("crcs"), get("blocks"), np.array(get("words"), np.int64))
                counts, names = np.array(get("counts"), np.int64), get("doc_ids")
                edges, start = np.concatenate(([0], np.cumsum(counts))), get("start")
                for begin in range(0, len(names), 500):
                    end = min(begin + 500, len(names))
                    own = edges[begin : end + 1]
                    lists = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(ids[own[0] : own[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(names[begin:end], pa.int64()), pa.array(start + own[:-1], pa.int64()), lists], ["doc_id", "start", "ids"])

    # Frames get their start before they are unpacked: decoded ids are not shuffled.
    return frames.join(starts, ["part", "number"]).mapInArrow(tidy(run), "doc_id long, start long, ids array<int>")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            crcs = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(edges), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
