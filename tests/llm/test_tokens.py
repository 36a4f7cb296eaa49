import hashlib
import random
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalspark.llm import chat, token_files
from evalspark.llm import sentencepiece_codec as codec
from evalspark.llm.common import PartStore
from evalspark.plans.shared import new_folder

PROTO = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
WORDS = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
BYTES = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
TEXTS = st.lists(st.text(alphabet="ab ▁\né日\t.😀<s>[INST]/\\|", max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_and_spans_equal_the_library(texts):
    ids, begins, ends, counts = codec.load(PROTO).encode(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        want = LIBRARY.encode(text, return_type="proto").pieces
        assert ids[at : at + n].tolist() == [p.id for p in want]
        data = text.encode()
        spans = list(zip(begins[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True))
        assert b"".join(data[a:b] for a, b in spans) == data
        assert spans == [(p.begin, p.end) for p in want]
        at += n


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_normalisation_through_the_character_map(rule, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    spec = next(v for n, _, v in codec._fields(library.serialized_model_proto()) if n == 3)
    model = codec.Model.__new__(codec.Model)
    model.map = codec.CharacterMap({n: v for n, _, v in codec._fields(spec)}[2])
    model.dummy_prefix = model.escape = True
    model.trim, model.suffix, model.user_defined = trim, False, []
    for text in ("  Ｈello　Ｗorld ﬁ  x ", "½ ™ Å é ｶﾞ ㈱  ", "ÀÉ ß İ", "", " ", "a\n b"):
        want, offsets = library.normalize(text, with_offsets=True)
        have, align = model.normalise(text)
        assert have == want
        places = np.cumsum([0, *(len(c.encode()) for c in have)])
        assert align[places].tolist() == [len(text[:o].encode()) for o in offsets][: len(places)] or not have


def test_encode_and_decode_in_spark(docs_of, odd_rows):
    rows = codec.decode(codec.encode(docs_of(odd_rows).select("doc_id", "text", "size"), PROTO), PROTO).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == LIBRARY.decode(r.ids) and len(r.begins) == len(r.ids)
    assert codec.encode(docs_of([]).select("doc_id", "text"), PROTO).count() == 0


def test_results_replace_columns_of_their_name(docs_of, odd_rows):
    docs = docs_of(odd_rows).selectExpr("*", "7 AS begins", "'gone' AS _source", "text AS ends").drop("text").withColumnRenamed("ends", "text")
    found = codec.encode(docs, PROTO, decoded="score", round_trip="kept")
    assert len(set(found.columns)) == len(found.columns) and found.schema["ids"].dataType.simpleString() == "array<int>"
    for r in found.collect():
        assert r.ids == LIBRARY.encode(r.text or "") and r.score == LIBRARY.decode(r.ids) and r.kept == (r.score == (r.text or "")) and r._source == "gone"
    named = docs.select(F.col("text").alias("ids"))  # the source itself gives way
    assert sorted(tuple(r.ids) for r in codec.encode(named, PROTO, "ids").collect()) == sorted(tuple(LIBRARY.encode(t or "")) for _, t in odd_rows)
    assert codec.decode(found.select("ids", "score"), PROTO, out="score").columns == ["ids", "score"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=80), st.integers(1, 4))
def test_blocks_round_trip(ids, times):
    ids = np.array(ids * times, np.int64)
    assert token_files.unpack(*token_files.pack(ids)).tolist() == ids.tolist()


def test_blocks_are_independent_checked_and_small():
    rng = np.random.default_rng(2)
    ids = np.tile(rng.zipf(1.5, 5000) % 3000, 2)
    lengths, crcs, blocks = token_files.pack(ids)
    assert sum(map(len, blocks)) < 1.2 * len(ids)  # raw: two bytes each
    assert token_files.unpack(lengths[1:2], crcs[1:2], blocks[1:2]).tolist() == ids[2048:4096].tolist()
    spoilt = blocks[0][:40] + bytes([blocks[0][40] ^ 1]) + blocks[0][41:]
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack(lengths[:1], crcs[:1], [spoilt])


def test_larger_ids_and_blocks_of_several_widths():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, top, 3000) for top in (10, 1 << 16, (1 << 16) + 1, 1 << 20, 1 << 31)]
    parts[2][5] = 1 << 16
    packed = [token_files.pack(p) for p in parts]
    for part, found in zip(parts, packed, strict=True):
        assert token_files.unpack(*found).tolist() == part.tolist()
    together = [sum((list(p[k]) for p in packed[::-1]), []) for k in range(3)]
    assert token_files.unpack(*together).tolist() == np.concatenate(parts[::-1]).tolist()
    assert [p[2][0][0] for p in packed] == [0, 0, 1, 1, 4]
    with pytest.raises(ValueError, match="below"):
        token_files.pack(np.array([1 << 31]))


def test_coders_give_out_bits_about_once_a_step(monkeypatch):
    """All lanes go on together, so each round in which some lane gives out bits costs a pass of its own."""
    monkeypatch.setattr(token_files, "BLOCK", 64)
    ids = np.random.default_rng(6).integers(0, 1 << 16, 64 * 300)
    calls = {"step": 0, "_next": 0}
    for name in calls:
        def counted(self, *given, name=name, whole=getattr(token_files._Coder, name)):
            calls[name] += 1
            return whole(self, *given)

        monkeypatch.setattr(token_files._Coder, name, counted)
    packed = token_files.pack(ids)
    calls["step"] = 0
    assert token_files.unpack(*packed).tolist() == ids.tolist()
    assert calls["_next"] <= 1.5 * calls["step"]
    short = [packed[2][0][:-1]]
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack(packed[0][:1], packed[1][:1], short)


def test_words_are_cut_only_where_the_tokenizer_allows_it():
    assert token_files.cuts_at_white_space(Tokenizer.from_str(WORDS))
    assert not token_files.cuts_at_white_space(Tokenizer.from_str(BYTES))  # its pieces begin with a space


def test_whole_texts_and_many_frames(spark, docs_of, odd_rows):
    """A tokenizer that joins words to the space before them; a frame for every 50 ids, so a document can be longer."""
    library, path = Tokenizer.from_str(BYTES), new_folder(spark, "token-files")
    rows = [*odd_rows, *[(100 + k, "a b  c\n" * (k % 40)) for k in range(60)]]
    token_files.write(docs_of(rows), BYTES, 70_000, path, frame_ids=50)
    frames = spark.read.parquet(path)
    assert frames.count() > 20 and frames.agg(F.max(F.size("doc_ids"))).first()[0] > 1
    found = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (name, text) in zip(found, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 70_000]
        assert (r.doc_id, r.start, r.ids) == (name, at, ids)
        at += len(ids)


def test_token_files_equal_the_library(spark, docs_of, odd_rows):
    library = Tokenizer.from_str(WORDS)
    rows = [*odd_rows, (8, "ΣΑΣ Don't  stop <|endoftext|>x y")]
    path = new_folder(spark, "token-files")
    token_files.write(docs_of(rows), WORDS, 1, path)
    found = token_files.ids_crc32(token_files.read(spark, path)).collect()
    found.sort(key=lambda r: r.start)
    at = 0
    for r, (name, text) in zip(found, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (name, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = new_folder(spark, "token-files")
    token_files.write(docs_of([]), WORDS, 1, path)
    assert token_files.read(spark, path).count() == 0


CHATS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<\\/s> <|/turn|>\n<|user|>"), (2, 1, "assistant", "b"), (2, 0, "system", None),
    (2, 2, None, "x"), (2, 2, None, "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "日本\n\n"), (None, 0, "assistant|>\n", "a"), (4, None, "assistant", "[INST<<SYS>><</SYS>>"),
]


def test_chats_are_read_back(spark):
    turns = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS ids", "2 AS formatted")
    done = chat.format_chats(turns, BYTES)
    done = done.select("conv_id", "formatted", "ids", "loss", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_begin"), F.col("loss_end")).alias("said"))
    found = {r.conv_id: r for r in done.collect()}
    for name in {c[0] for c in CHATS}:
        mine = sorted((c for c in CHATS if c[0] == name), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or ""))
        assert [(t.role, t.text) for t in found[name].turns] == [(c[2] or "", c[3] or "") for c in mine]
        assert found[name].said == "".join(c[3] or "" for c in mine if c[2] == "assistant")
        assert len(found[name].ids) == len(found[name].loss)
        for control in ("</s>", "[INST]", "<<SYS>>"):
            assert control not in found[name].formatted
    assert chat.format_chats(turns.where("false"), BYTES).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(5)
    parts = [*chat.CONTROLS, "\\", "<", "[", "|", "/s>", "s>", "a", "\n", "INST]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.tuples(st.integers(1, 3), st.integers(1, 5)), max_size=5), st.integers(0, 2))
def test_intersection_equals_brute_force(tokens, spans, share):
    edges = np.cumsum([0, *tokens])
    begin, end = edges[:-1], np.minimum(edges[1:] + share, edges[-1])  # tokens may share characters
    at, left, right = 0, [], []
    for gap, size in spans:
        left.append(at + gap)
        right.append(at + gap + size)
        at += gap + size
    touched, a, b = chat.intersect(begin, end, np.array(left, int), np.array(right, int))
    inside = {c for x, y in zip(left, right) for c in range(x, y)}
    assert touched.tolist() == [bool(inside & set(range(x, y))) for x, y in zip(begin, end)]
    covered = [c for x, y in zip(a, b) for c in range(x, y)]
    assert covered == sorted(inside & {c for x, y in zip(begin, end) for c in range(x, y)})


def test_digest_of_ids(docs_of):
    row = codec.encode(docs_of([(1, "a b")]).select("doc_id", "text"), PROTO).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("d")).first()
    assert row.d == hashlib.sha256(",".join(map(str, LIBRARY.encode("a b"))).encode()).hexdigest()


WORD_LIBRARY = Tokenizer.from_str(WORDS)
PARTS = token_files.Parts(WORD_LIBRARY)
ODD_WORDS = st.lists(
    st.text(alphabet="aZé'sSÉßÿÞªµº×÷ſK\u212bİ²½٣9_.,&日\u0301\u0327\x00\x01\x1f\x7f<|> \n\t", min_size=1, max_size=9)
    | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b.", "<|EndOfText|>", "don't", "IT'S", "we'LL''d", "e\u0301té,", "\u00c9t\u00e9."]),
    max_size=30,
)


@settings(max_examples=300, deadline=None)
@given(ODD_WORDS, st.sampled_from([" ", "", "\r\n", "\u00a0", "\u2028"]))
def test_parts_of_texts_equal_the_library(words, gap):
    text = gap.join(words)
    ids = [i for part in PARTS.encode(PARTS.cut(text)) for i in part]
    assert ids == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_with_equal_pieces_are_encoded_once():
    cuts = [PARTS.cut(t) for t in ("Grün, grün. GRÜN...\tgrün,12.", "日本 Grün, <|endoftext|> grün.")]
    assert cuts[0] == ["grün", ",", "grün", ".", "grün", "...", "grün", ",", "1", "2", "."]
    assert cuts[1] == ["日本", "grün", ",", "<|endoftext|>", "grün", "."]


def test_plain_pieces_go_to_the_model_alone():
    class Model:
        model = WORD_LIBRARY.model
        to_str = WORD_LIBRARY.to_str

    pieces = ["grün", "...", "1", "'s", "ß"]
    assert token_files.Parts(Model()).encode(pieces) == [WORD_LIBRARY.encode(p, add_special_tokens=False).ids for p in pieces]


def test_other_tokenizers_cut_words_only():
    library = Tokenizer.from_str(BYTES)
    parts = token_files.Parts(library)
    assert not parts.known and parts.cut("Grün, don't\n") == ["Grün,", "don't"]
    assert parts.encode(["Grün,", "don't"]) == [library.encode(w, add_special_tokens=False).ids for w in ("Grün,", "don't")]


def test_an_id_is_one_step_of_the_coder(monkeypatch):
    """Weights of the orders, class and place in it narrow a range at once; larger ranks take a second step."""
    calls = []
    whole = token_files._Coder.step
    monkeypatch.setattr(token_files._Coder, "step", lambda self, *given: (calls.append(1), whole(self, *given))[1])
    ids = np.random.default_rng(7).integers(0, 1 << 16, 2 * 2048)
    for some, most in ((ids, 2048), (ids + (1 << 20), 2 * 2048)):
        calls.clear()
        packed = token_files.pack(some)
        assert len(calls) <= most
        calls.clear()
        assert token_files.unpack(*packed).tolist() == some.tolist()
        assert len(calls) <= most


def test_words_of_a_frame_rank_its_ids():
    rng = np.random.default_rng(8)
    names = rng.permutation(np.unique(rng.integers(0, 1 << 31, 3000)))  # rare and frequent ids lie everywhere
    ids = names[np.minimum(rng.zipf(1.3, 40_000), len(names)) - 1]
    words = token_files.by_frequency(ids)
    assert sorted(words.tolist()) == np.unique(ids).tolist()
    packed = token_files.pack(ids, words)
    assert token_files.unpack(*packed, words).tolist() == ids.tolist()
    chances = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * sum(map(len, packed[2])) < len(ids) * (1 - (chances * np.log2(chances)).sum())
    with pytest.raises(ValueError, match="damaged"):  # checksums are of ids, not of ranks
        token_files.unpack(*packed, words[::-1])


def test_numbers_are_carried_and_damage_is_found_everywhere():
    rng = np.random.default_rng(9)
    for ids in (np.zeros(5000, int), np.full(5000, 65535), np.tile([0, 65535, 1, 32768], 1500), np.tile(rng.integers(0, 50, 700), 9), rng.integers(0, 3, 9000)):
        lengths, crcs, blocks = token_files.pack(ids)
        assert token_files.unpack(lengths, crcs, blocks).tolist() == ids.tolist()
        for place in rng.integers(1, len(blocks[0]) - 2, 5):
            spoilt = blocks[0][:place] + bytes([blocks[0][place] ^ 0xFF]) + blocks[0][place + 1 :]
            with pytest.raises(ValueError, match="damaged"):
                token_files.unpack(lengths[:1], crcs[:1], [spoilt])


def _parts_of(texts, parts=PARTS):
    found, order, counts = parts.cut_all(texts)
    in_row, out, at = [found[k] for k in order], [], 0
    for count in counts:
        out.append(in_row[at : at + count])
        at += count
    assert at == len(in_row)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(ODD_WORDS | st.lists(st.sampled_from(["it's", "''s", "we'll''d'", "'re've", "12a", "...'t", "x'l", "É'S"]), max_size=9), max_size=3), max_size=4))
def test_texts_cut_together_equal_the_library(groups):
    texts = [gap.join(chain.from_iterable(g)) for g, gap in zip(groups, (" ", "", "\n ", "\t"), strict=False)]
    for text, found in zip(texts, _parts_of(texts), strict=True):
        assert [i for part in PARTS.encode(found) for i in part] == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_cut_into_pieces_as_bytes():
    assert _parts_of(["Grün, don't 12", "", " \n", "aあ b", "'s"]) == [["grün".encode("latin-1"), b",", b"don", b"'t", b"1", b"2"], [], [], ["aあ", "b"], [b"'s"]]
    assert _parts_of(["Grün\n"], token_files.Parts(Tokenizer.from_str(BYTES))) == [["Grün"]]


def test_added_tokens_beyond_ascii_are_found():
    library = Tokenizer.from_str(WORDS)
    library.add_special_tokens(["É<x>", "<a b>", "あ."])
    parts = token_files.Parts(library)
    texts = ["Été É<x>é", "é<x> grün", "x <a\nb> <a b>.", "あ. y", "plain"]
    for text, found in zip(texts, _parts_of(texts, parts), strict=True):
        if "a b" not in text:  # spans white space, which cuts_at_white_space refuses
            assert [i for part in parts.encode(found) for i in part] == library.encode(text, add_special_tokens=False).ids
    assert not token_files.cuts_at_white_space(library)


def test_the_library_encodes_many_pieces_at_a_time():
    parts, calls = token_files.Parts(WORD_LIBRARY), []

    class Counted:
        def encode_batch_fast(self, rows, add_special_tokens):
            calls.append(1)
            return parts.whole.encode_batch_fast(rows, add_special_tokens=add_special_tokens)

    parts.whole, parts.row = parts.row, Counted()
    pieces = [f"{'abcdé'[k % 5]}{'xyzß'[k % 4]}{chr(97 + k % 26)}".encode("latin-1") for k in range(12_000)]
    found = parts.encode(pieces)
    assert len(calls) <= 3
    assert found[:400] == [WORD_LIBRARY.encode(p.decode("latin-1"), add_special_tokens=False).ids for p in pieces[:400]]


def test_a_full_store_is_emptied_and_goes_on():
    asked = []

    def encode(parts):
        asked.append(list(parts))
        return [[len(p)] * len(p) for p in parts]

    store = PartStore(encode, 3)
    assert [x.tolist() for x in store.ids(["a", "bb", "a"])] == [[1, 2, 2, 1], [1, 2, 1]]
    assert [x.tolist() for x in store.ids(["bb", "", "a"], np.array([2, 0, 0, 1]))] == [[1, 2, 2, 2, 2], [1, 2, 2, 0]]
    assert [x.tolist() for x in store.ids(["ccc", "a"])] == [[3, 3, 3, 1], [3, 1]]
    assert [x.tolist() for x in store.ids(["a", "a"])] == [[1, 1], [1, 1]]
    assert [x.tolist() for x in store.ids([])] == [[], []]
    assert asked == [["a", "bb"], [""], ["ccc", "a"]]
