"""Encoding equals the public library; decoding is an exact round trip of its tokens."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


ODD = ["", "Hello WORLD's it'LL don't", "a<|endoftext|>b <|startoftext|><|endoftext", "ÅΣΣ ΑΣ İx ½ ²", "\x1c\x85x​y　z q", "a" * 5000, "#" * 4001, "ab" * 3000, "日本語 漢字 😀👍🏽", "é ñ", "123 4567", "x\ny\r\n\tz"]


def test_odd_texts(library):
    v = bpe.Vocabulary(PATH)
    for text, ids in zip(ODD, v.encode(ODD), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:40]
        assert v.decode(ids.tolist()) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    v = bpe.vocabulary(PATH)
    library = Tokenizer.from_file(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert v.encode([text])[0].tolist() == want


def test_table_of_words_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    v = bpe.Vocabulary(PATH)
    for text in ("one two three four five", "one six <|endoftext|>", "seven"):
        assert v.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_columns(spark, documents, library):
    got = {(r.doc_id, r.text): r for r in bpe.decode(bpe.encode(documents, PATH), PATH).collect()}
    assert documents.columns == [c for c in documents.columns if c != "ids"][:0] + documents.columns
    for (_, text), r in got.items():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.kept == "clash"


def test_digests(spark, documents, library):
    rows = bpe.digests(documents, PATH).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in documents.select("doc_id", "text").collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4")
        by.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in by[r.doc_id] for r in rows)
    assert bpe.digests(documents.where("false"), PATH).count() == 0
    assert bpe.encode(documents.where("false"), PATH).count() == 0
