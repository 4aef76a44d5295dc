"""Byte-level BPE against the tiktoken library."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweft.llm import bpe, registry

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.load_ranks(registry.vocabulary_path())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CACHE = bpe.Pieces(RANKS, 5000)
TOKENS = bpe.Tokens(RANKS)


def same(texts):
    found, ends = bpe.encode_texts(texts, CACHE)
    begin = 0
    for text, end in zip(texts, ends):
        ids, begin = found[begin:end], end
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        offsets = TOKENS.offsets(ids)
        assert TOKENS.decode(ids, offsets) == text.encode() and len(offsets) == len(ids) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'strevlmd  \n\t.,!9  "), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=6))
def test_texts(texts):
    same(texts)


def test_every_code_point():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(points), 20_000):
        same(["".join(f"a{c}1{c}!{c} {c}" for c in points[i : i + 20_000])])


def test_long_pieces():
    r = random.Random(0)
    same(["x" * 20_000, "ab" * 5000, " " * 5000 + "a", "!?" * 3000, "".join(r.choice("abcdefgh") for _ in range(20_000))])


def test_columns(spark):
    """Encoded in Spark, each id stands at its offset, and decoding gives the texts back; null is an empty text."""
    texts = ["", None, "a  b\n\nc's 12é", "日本 " * 3000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, registry.vocabulary_path())
    by_rank = {r: t for t, r in RANKS.items()}
    for r in encoded.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.ids == LIBRARY.encode_ordinary(raw.decode())
        assert all(raw[at:].startswith(by_rank[i]) for i, at in zip(r.ids, r.offsets))
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, registry.vocabulary_path()).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert encoded.limit(0).count() == 0


def test_pieces_with_one_hash(monkeypatch):
    """Pieces are told apart where their hashes aren't."""
    monkeypatch.setattr(bpe, "mix", lambda x: x * 0)
    same(["one two three", "four five two"])
