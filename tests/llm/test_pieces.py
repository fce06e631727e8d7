"""Operator 13 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from codeweave.llm import pieces, queries

from .conftest import SF_SMALL

SIGNS = ["a", "b", "e", "th", " ", "  ", "▁", "\n", "\t", "\r", "é", "日", "本", "\x00", "‍", "😀", "<s>", "</s>", "<0x0A>",
         "<unk>", "1", "2", ".", ",", "�", "﻿", "א", "\x85", "　", "ﬁ", "Å"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [
        "", " ", "▁", "▁▁▁", "a" * 3000, " " * 5000, "ab" * 3000 + " " * 37 + "x", "));\r\r\n\");\r'"]


def test_ids_and_texts_are_the_librarys(vocabulary, library, texts):
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), repr(text)
        assert vocabulary.decode(ids.tolist()) == library.decode(ids.tolist())


def test_heap_and_rows_agree(vocabulary, texts):
    by_length = {}
    for t in texts:
        for s in vocabulary.cut(t):
            by_length.setdefault(len(s), set()).add(s)
    for n, some in by_length.items():
        some = sorted(some)
        if n <= pieces.SHORT:
            assert [np.frombuffer(x, dtype=np.int32).tolist() for x in vocabulary.merged_together(some)] == [
                vocabulary.merged(s) for s in some]


def test_decoding_any_ids(vocabulary, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([1, 2, rng.randint(3, 258), rng.randint(3, 31999), 29871]) for _ in range(rng.randint(0, 12))]
        assert vocabulary.decode(ids) == library.decode(ids), ids


def test_a_wrong_table_is_noticed(library):
    v = pieces.Vocabulary(pieces.default_model())
    v.pair_place = v.pair_place[::-1].copy()
    with pytest.raises(RuntimeError):
        v.encode(["internationalization considerations nevertheless"])


def test_long_texts_are_cut_at_proven_places(monkeypatch, vocabulary, library):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    text = "word  and   more\n" * 40 + "x" * 200 + "   " * 90
    assert len(list(vocabulary.blocks(text))) > 5
    assert vocabulary.encode([text])[0].tolist() == library.encode(text, add_eos=True)


def test_few_known_segments(monkeypatch, library):
    monkeypatch.setattr(pieces, "KNOWN", 10)
    v = pieces.Vocabulary(pieces.default_model())
    for text in ("one two three four five six", "seven eight nine ten eleven", "one two three twelve"):
        assert v.encode([text])[0].tolist() == library.encode(text, add_eos=True)
        assert len(v.known) < 20


def test_operator(make, corpus, library):
    got = pieces.encode(make(corpus))
    want = sorted(((d, library.encode(t or "", add_eos=True)) for d, t in corpus), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr) == want
    again = pieces.decode(got.select("doc_id", "ids"))
    assert sorted(((r.doc_id, r.decoded) for r in again.collect()), key=repr) == sorted(
        ((d, library.decode(i)) for d, i in want), key=repr)
    assert pieces.encode(make([])).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in queries.op13_pieces(spark, SF_SMALL).collect():
        ids = library.encode(docs.pop(r.doc_id), add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not docs
