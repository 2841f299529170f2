"""SentencePiece BPE by rounds against the library."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path

from lakescribe.llm import merge_rounds

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _ids(own, text):
    return np.frombuffer(next(own.encode([text])), "<u4").tolist()


def test_encoding_is_the_librarys(library):
    rnd, own = random.Random(1), merge_rounds.Encoder(MODEL)
    odd = ["a", "b", "e", " ", "  ", "\n", "\t", "▁", "the", "ing", " ab", "1", "23", "é", "中", "文", "🙂", "​", "ﬁ", "\x00", ".", "..", "<s>", "</s>", "<unk>", "<0x41>", "-", "--", "//"]
    plain = list("abcdefghijklmnopqrstuvwxyz   .,")
    for k in range(6000):
        text = "".join(rnd.choice(odd if k % 2 else plain) for _ in range(rnd.randrange(40)))
        ids = _ids(own, text)
        assert ids == library.encode(text, add_eos=True) and own.decode(ids) == library.decode(ids), text
    texts = ["", " ", "   ", "x" * 3000, " " * 500 + "y", "".join(rnd.choice("abcdefghij") for _ in range(5000)), "é" * 400, "中文" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library.encode(texts, add_eos=True)


def test_rounds_and_heap_agree():
    """Words of any length give the same by rounds as pair by pair."""
    rnd, p = random.Random(2), merge_rounds.Encoder(MODEL).pieces
    words = ["▁" * rnd.randrange(3) + "".join(rnd.choice("abcdeinorst▁") for _ in range(rnd.randrange(1, 300))) for _ in range(200)]
    symbols = [p.of_char[np.frombuffer(w.encode("utf-32-le"), "<u4")] for w in words]
    left, starts = p.merged(np.concatenate(symbols), np.array(list(map(len, words))))
    want, at = [], 0
    for s in symbols:
        ids, places = p.one_by_one(s.tolist())
        want += [(k, at + x) for k, x in zip(ids, places, strict=True)]
        at += len(s)
    assert list(zip(left.tolist(), starts.tolist(), strict=True)) == want


def test_decoding_of_any_ids(library):
    rnd, own = random.Random(3), merge_rounds.Encoder(MODEL)
    for _ in range(8000):
        ids = [rnd.choice([0, 1, 2, 35, 259, 260, 300, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD, 3 + 0xF0, 3 + 65, 3 + 0xE2, 3 + 0x96, 3 + 0x81, rnd.randrange(32000)]) for _ in range(rnd.randrange(6))]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_words_take_no_longer():
    own = merge_rounds.Encoder(MODEL)
    for text in ("ab" * 100_000, " " * 200_000, "x" * 200_000):
        began = time.process_time()
        _ids(own, text)
        assert time.process_time() - began < 10


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(merge_rounds, "STORED_WORDS", 10)
    own = merge_rounds.Encoder(MODEL)
    list(own.encode([f"word{k} other" for k in range(100)]))
    list(own.encode(["again"]))
    assert len(own) <= 10


def test_rows(spark, odd_docs, no_docs, library):
    found = merge_rounds.round_trip(odd_docs, MODEL).collect()
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    want = []
    for ids in library.encode(texts, add_eos=True):
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(want)
    assert merge_rounds.round_trip(no_docs, MODEL).count() == 0
    back = merge_rounds.decode_ids(merge_rounds.encode_ids(odd_docs, MODEL), MODEL).collect()
    assert sorted(r["decoded"] for r in back) == sorted(library.decode(x) for x in library.encode(texts, add_eos=True))
    assert merge_rounds.decode_ids(merge_rounds.encode_ids(no_docs, MODEL), MODEL).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in merge_rounds.decode_ids(nothing, MODEL).collect()] == [None, ""]
