"""Encoding by merge replay, against the public tokenizer library and back again."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from kithspark.llm.bpe import Encoder, encode_corpus, load_ranks, vocabulary_path

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_round_trip(encoder, text):
    token = {v: k for k, v in encoder.ranks.items()}
    assert b"".join(token[i] for i in encoder.encode([text])[0]) == text.encode("utf-8", "surrogatepass")


def test_equal_to_the_library(encoder, library):
    r = random.Random(1)
    texts = ["".join(r.choice("aab  'Aé́​\n\t<|endoftext|>s12\U0001f600x日本ж") for _ in range(r.randint(0, 70))) for _ in range(2000)]
    texts += ["a" * 20_000, "<|endoftext|>", "  \n\n  x ", "don't we'll I'm", "word " * 9000, "日本語" * 3000]
    assert encoder.encode(texts) == library(texts)


def test_words_together_or_apart_have_the_same_ids(encoder):
    words = ["aaaa", "banana", "bandana", " banana", "ana", "nana"]
    alone = [Encoder(encoder.ranks).encode([w])[0] for w in words]
    assert Encoder(encoder.ranks).encode(words) == alone


def test_memory_may_be_emptied(encoder, monkeypatch):
    from kithspark.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "LAID_OUT", 5)
    fresh = Encoder(encoder.ranks)
    assert [fresh.encode([t])[0] for t in ("one two three four five", "two six")] == [encoder.encode([t])[0] for t in ("one two three four five", "two six")]


def test_frames(spark, library):
    texts = [None, "", " ", "hello", "hello", "ж\r\n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "hello", 2)], "doc_id bigint, text string, ids int")
    got = encode_corpus(df, "doc_id", "text", vocabulary_path(spark))
    assert got.columns == ["doc_id", "ids"]
    rows = {r.doc_id: list(r.ids) for r in got.collect()}
    assert rows == {i: library([t or ""])[0] for i, t in enumerate(texts)} | {None: library(["hello"])[0]}
    assert encode_corpus(df.limit(0), "doc_id", "text", vocabulary_path(spark)).count() == 0
