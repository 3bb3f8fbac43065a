import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import pieces, token_files
from tidewater.llm.chunks import ChunkTable
from tidewater.llm.queries import tokenizer_path

spm = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
MODEL, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t▁aeétù.,'s<|>\\0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    sp = pieces.codec(MODEL).sp
    (ids, decoded), *_ = pieces.codec(MODEL).encode_decode([text, text])
    assert pieces.codec(MODEL).ids([text]) == [ids]
    want = sp.encode(text, add_bos=True, add_eos=True)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert decoded.decode() == sp.decode(want)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_words_equal_the_library(text):
    own = token_files.codec(BYTES)
    want = own.tok.encode(text, add_special_tokens=False).ids
    got, _ = own.encode([text, "x"])
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want


def test_many_new_words_are_one_text_for_the_library(monkeypatch):
    own, given_texts = token_files.ByteCodec(BYTES), []

    class Counted:
        def encode_batch_fast(self, texts, **settings):
            given_texts.extend(texts)
            return inner.encode_batch_fast(texts, **settings)

    inner = own.tok
    texts = [f"{i}x qu{i}r, 漢{i}\u3000 b<{i} {i}< é.\n{i}" for i in range(400)] + ["", "a"]
    want = [np.array(e.ids, "<u4").tobytes() for e in inner.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(own, "tok", Counted())
    assert own.encode(texts) == want
    assert len(given_texts) < len(texts) / 10
    given_texts.clear()
    odd = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "so new<|"]
    assert own.encode(odd) == [np.array(e.ids, "<u4").tobytes() for e in inner.encode_batch_fast(odd, add_special_tokens=False)]


def test_a_word_of_many_texts_is_looked_up_once(monkeypatch):
    own, asked = token_files.ByteCodec(BYTES), []
    packed = own.words.packed
    monkeypatch.setattr(own.words, "packed", lambda chunks: asked.extend(chunks) or packed(chunks))
    texts = ["x same words again", "y  same words\u00a0 again ", "", " ", "same", "again same"] * 50
    texts += [f"a{w} b same" for w in token_files.WHITE] + [f"a {w}b same" for w in token_files.WHITE]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert own.encode(["x", "", " "]) == [np.array(e.ids, "<u4").tobytes() for e in own.tok.encode_batch_fast(["x", "", " "], add_special_tokens=False)]
    assert own.encode([]) == []
    assert len(asked) == len(set(asked)) > 2


def test_chunk_table_is_right_at_any_bound():
    calls = []

    def segment(chunks):
        calls.append(len(chunks))
        return [c.encode() for c in chunks]

    table = ChunkTable(segment, most=3)
    for _ in range(3):
        assert table.packed(["a", "b", "a", "c", "d"]) == [b"a", b"b", b"a", b"c", b"d"]
        assert table.packed(["e"]) == [b"e"]


def test_piece_query(docs, rows):
    got = {r["ids_sha256"] for r in pieces.piece_digests(pieces.encode_pieces(docs, MODEL)).collect()}
    sp = spm.SentencePieceProcessor(model_file=MODEL)
    want = set()
    for r in rows:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.add(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert got == want


def test_pieces_of_an_empty_table(empty):
    assert pieces.encode_pieces(empty, MODEL).count() == 0


def test_files_hold_every_document_in_order(spark, docs, rows):
    got = token_files.token_files_of(spark, docs, BYTES).collect()
    tok = tokenizers.Tokenizer.from_file(BYTES)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in ordered:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want


def test_files_of_an_empty_table(spark, empty):
    assert token_files.token_files_of(spark, empty, BYTES).count() == 0


def test_random_access_and_damage(tmp_path):
    path = tmp_path / "s.twt"
    data = {i: np.arange(i * 7 % 50, dtype="<u4") for i in range(200)}
    with open(path, "wb") as f:
        w = token_files.ShardWriter(f, frame_bytes=500)
        for i, ids in data.items():
            w.add(i, ids.tobytes())
        w.close()
    got = token_files.read_documents(f"file://{path}", [3, 150, 199, 1000])
    assert set(got) == {3, 150, 199} and all((got[i] == data[i]).all() for i in got)
    with open(path, "rb") as f:
        reader = token_files.ShardReader(f, path.stat().st_size)
        assert len(reader.seek) > 5
        frames = []
        reader.frame, whole = (lambda i, old=reader.frame: frames.append(i) or old(i)), reader.seek
        reader.get([3])
        assert frames == [int(reader.docs["frame"][3])] and len(whole) > 5
    raw = bytearray(path.read_bytes())
    raw[10] ^= 1
    path.write_bytes(raw)
    with open(path, "rb") as f, pytest.raises((ValueError, Exception)):  # noqa: B017, PT011
        list(token_files.ShardReader(f, len(raw)))
    with pytest.raises(ValueError, match="not a token shard"):
        token_files.ShardReader(__import__("io").BytesIO(b"short"), 5)
