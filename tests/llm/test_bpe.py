import base64
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from kithloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary")


@pytest.fixture(scope="module")
def known():
    with open(bpe.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.BYTE_BPE_50K)


TEXTS = [
    "", " ", "\n\n  \t x", "Hello world's 1234567 don't!!", "Ä ß ñ Ünïcode", "日本語のテキスト、混在 text", "Привет, мир", "مرحبا", "👩‍🌾🙂", "a" * 3000,
    "ab" * 2000, "\x00\x01​﻿", "<|endoftext|>", "  leading and trailing  ", "x y　z", "'s 't 're", "ẹ́",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(own, known, text):
    assert own.encode(text) == known.encode_ordinary(text)
    assert known.decode(own.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(text):
    own = bpe.encoder(bpe.BYTE_BPE_50K)
    assert own.encode(text) == _merged_plainly(own, text)


def _merged_plainly(own, text):
    """Merging by definition: again and again the leftmost pair of the smallest rank."""
    out = []
    for piece in own.pieces(text):
        ids = [own.bytes[b] for b in piece.encode("utf-8", "replace")]
        while True:
            best = min(((own.pairs.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        out += ids
    return out


def test_one_long_piece(own, known):
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshr") for _ in range(60_000))
    assert own.encode(text) == known.encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch, known):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.BytePairEncoder()
    text = "one two three four five one two three four five"
    assert small.encode(text) == known.encode_ordinary(text) and len(small.memory) <= 3


def test_frames(frame, known):
    rows = [(1, t, "clash") for t in TEXTS] + [(2, None, ""), (None, "null key", "")]
    df = frame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted((k or 0, known.encode_ordinary(t or "")) for k, t, _ in rows)
    counts = sorted(r.n_tokens for r in bpe.count_tokens(df, ["doc_id"], "text").collect())
    assert counts == sorted(len(known.encode_ordinary(t or "")) for _, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert bpe.encode_texts(df, "doc_id", "text").schema["ids"].dataType.simpleString() == "array<int>"


def test_other_vocabulary(frame):
    path = os.path.join(bpe.TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    own = bpe.BytePairEncoder(path)
    for text in TEXTS:
        assert own.encode(text) == other.encode_ordinary(text)


def test_bytes_that_are_no_text(spark):
    rows = spark.sql("SELECT 1L AS doc_id, cast(unhex('41FFFE42') AS string) AS text UNION ALL SELECT 2L, 'A\ufffd\ufffdB'")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(rows, "doc_id", "text").collect()}
    assert got[1] == got[2]
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(rows, ["doc_id"], "text").collect()} == {1: len(got[1]), 2: len(got[2])}
    assert bpe.encoder(bpe.BYTE_BPE_50K).encode("A\ud800B") == bpe.encoder(bpe.BYTE_BPE_50K).encode("A\ufffdB")
