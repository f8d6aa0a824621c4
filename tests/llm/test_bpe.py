import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from placebook.llm import bpe
from placebook.llm.queries import VOCABULARY, op3_byte_pair_encoding

PATH = public_tokenizers.path(VOCABULARY)
DATA = open(PATH, "rb").read()
ENCODER = bpe._encoder(DATA)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ENCODER.ranks), special_tokens={})
SPLIT = bpe.splitter(public_tokenizers.PATTERN)


def encoded(text):
    return [token for piece in SPLIT(text) for token in ENCODER.encode_piece(piece.encode())]


def test_ranks_are_read():
    lines = [line.split() for line in DATA.splitlines() if line]
    assert ENCODER.ranks == {base64.b64decode(token): int(rank) for token, rank in lines}
    assert ENCODER.sound


ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t\r'sdtrevml019aeioun.,!?-\x1c\x85\xa0\u2003\u3000éßñçя中😀𝔸½²ª")))


@settings(max_examples=600, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_equals_tiktoken(text):
    assert encoded(text) == PEER.encode_ordinary(text)
    assert ENCODER.decode(encoded(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3000, "\n" * 999 + "x", "é" * 2000, "thththerer" * 500, "", "don't we'll 's 'S''s"])
def test_long_and_odd_texts_equal_tiktoken(text):
    assert encoded(text) == PEER.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abehnrst", max_size=80), st.data())
def test_appends_and_edits_equal_a_new_encoding(text, data):
    piece = bpe.EditedPiece(ENCODER, text.encode())
    more = data.draw(st.text("abehnrst", max_size=10)).encode()
    piece.append(more)
    assert piece.tokens() == bpe.EditedPiece(ENCODER, text.encode() + more).tokens()
    start = data.draw(st.integers(0, len(piece.data)))
    stop = data.draw(st.integers(start, len(piece.data)))
    wanted = piece.data[:start] + more + piece.data[stop:]
    piece.replace(start, stop, more)
    assert piece.data == wanted and piece.tokens() == bpe.EditedPiece(ENCODER, wanted).tokens()


def test_an_edit_is_computed_near_its_place():
    piece = bpe.EditedPiece(ENCODER, b"thehereinonat" * 400)
    before = piece.computed
    piece.replace(100, 103, b"xyz")
    assert piece.computed - before < 103 + 3 * ENCODER.longest
    assert piece.tokens() == bpe.EditedPiece(ENCODER, piece.data).tokens()


def test_a_vocabulary_without_an_order_of_parts_is_encoded_too():
    ranks = {bytes([i]): i + 1000 for i in range(256)} | {b"ab": 5, b"bc": 3, b"abc": 1, b"cab": 0}
    peer = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.BytePairEncoder(ranks)
    for text in ("abc", "abcab", "cabcabc", "bcabab", "aabbccab", "abcabcabcabc"):
        assert list(own.encode_piece(text.encode())) == peer.encode_ordinary(text)


def test_pieces_encoded_together_equal_single_ones():
    pieces = ["", "a", "ththe", "ththerer", "ththererx", " diechpfkeitte", "\0", "a\0", "\0\0x", "éé" * 9, "中文字" * 30, "ab" * 90, " the", "x"]
    together = ENCODER.encode_pieces([piece.encode() for piece in pieces])
    assert [list(memoryview(packed).cast("I")) for packed in together] == [ENCODER.encode_piece(piece.encode()) for piece in pieces]
    assert bpe.Pieces(ENCODER).encode([pieces[1:], [], pieces[1:4]]) == [b"".join(together[1:]), b"", b"".join(together[1:4])]
    odd = bpe.BytePairEncoder({bytes([i]): i + 1000 for i in range(256)} | {b"ab": 5, b"bc": 3, b"abc": 1, b"cab": 0})
    texts = [b"abcab", b"cabcabc", b"bcabab", b"aabbccab"]
    assert [list(memoryview(packed).cast("I")) for packed in odd.encode_pieces(texts)] == [odd.encode_piece(text) for text in texts]


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "the end", "x"), (1, "the end", "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode(), len(r.ids) // 4) for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect())
    n = len(PEER.encode_ordinary("the end"))
    assert got == [(0, "", 0), (1, "the end", n), (1, "the end", n), (2, "", 0)]
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_tiktoken(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = op3_byte_pair_encoding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = PEER.encode_ordinary(texts[row.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
