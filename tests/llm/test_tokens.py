"""Token counts, byte-level BPE and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakescribe.llm import packing, prefix_bpe, token_counts
from lakescribe.llm.wordpieces import word_pieces

WORD = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "aa", "ab", " ", "  ", "\n", "é", "ß", "中", "😀", "0", "12", "---", "=", "the", "ing", "́", "'s", "'", "İ", "\xa0", "Σ", "া", "ᅡ", "K", "\x1c", "\x85", "'ll", "½"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})


def _texts(n, longest, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_words_as_library(library):
    store = word_pieces(WORD)
    for text in [*_texts(1500, 60), "<|endoftext|> a<|startoftext|>b", "<| endoftext", "a\x0bb\x0cc\x1fd", "it's, 'tis 'LL's-- x'd1'2.5e-3\r\n\t don't"]:
        assert np.frombuffer(store.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (64, 8), (40, 2), (7, 5)])
def test_splices_are_exact(library, chunk, overlap):
    encode = lambda t: library.encode(t, add_special_tokens=False)
    for text in [*_texts(400, 400, 2), "x" * 3000, "ab" * 700 + " " + "c" * 900]:
        assert [i for part in token_counts.spliced(encode, text, chunk, overlap) for i in part] == encode(text).ids, text


def test_count_tokens(odd_docs, no_docs, library):
    found = token_counts.count_tokens(odd_docs, WORD, chunk=1000, overlap=32).collect()
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found}
    want = {(r["doc_id"], len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for r in odd_docs.collect() for t in [r["text"] or ""]}
    assert rows == want and len(found) == odd_docs.count()
    assert token_counts.count_tokens(no_docs, WORD).count() == 0


def test_prefix_tables(reference):
    ranks = prefix_bpe.codec(RANKS, P.PATTERN).ranks
    rnd = random.Random(5)
    for _ in range(300):
        data = bytes(rnd.choice(b"aab the in-- =\xc3\xa9qu") for _ in range(rnd.randint(1, 200)))
        table = prefix_bpe.PrefixTable(ranks, data[: len(data) // 2])
        table.append(data[len(data) // 2 :])
        assert table.ids() == reference._core_bpe.encode_single_piece(data)
        a = rnd.randint(0, len(data))
        b, new = rnd.randint(a, len(data)), bytes(rnd.choice(b"the qu") for _ in range(rnd.randint(0, 9)))
        table.replace(a, b, new)
        assert table.last == prefix_bpe.PrefixTable(ranks, data[:a] + new + data[b:]).last
    long = prefix_bpe.PrefixTable(ranks, bytes(rnd.choice(b"abcdefgh ") for _ in range(5000)))
    assert long.replace(100, 101, b"z") < 1000  # near the edit only


def test_codec_as_tiktoken(reference, odd_docs, no_docs):
    own = prefix_bpe.codec(RANKS, P.PATTERN)
    texts = _texts(1500, 60, 7)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in prefix_bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert found == want
    assert prefix_bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    both = prefix_bpe.decode_ids(prefix_bpe.encode_ids(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in both) == sorted((r["text"] or "").encode() for r in odd_docs.collect())


def _check_plan(histogram, capacity):
    fill, used = {}, {}
    for length, rank, many, first, offset in packing.plan(histogram, capacity):
        used.setdefault(length, []).append((rank, many))
        for k in range(many):
            fill.setdefault(first + k, []).append((offset, length))
    for length, runs in used.items():
        at = 0
        for rank, many in sorted(runs):
            assert rank == at
            at += many
        assert at == histogram[length]
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(len(fill)))
    return len(fill)


def _best_fit_decreasing(histogram, capacity):
    rooms = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= length), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - length)
        else:
            rooms[k] -= length
    return len(rooms)


def test_plan_is_best_fit():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.choice([10, 37, 100])
        histogram = {x: rnd.randint(1, 9) for x in rnd.sample(range(1, capacity + 1), rnd.randint(1, min(8, capacity)))}
        assert _check_plan(histogram, capacity) == _best_fit_decreasing(histogram, capacity)
    assert len(packing.plan({k: 10**9 for k in range(1, 2049)})) < 60_000  # however many pieces there are


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    """Rows that are equal throughout, or without ids, part for their ranks, and each takes a slot of its own."""
    monkeypatch.setattr(packing, "LEAST", 4)
    docs = spark.range(1000).selectExpr("if(id < 500, 1, null) AS doc_id", "'the same words' AS text")
    pieces = packing.token_pieces(docs, WORD)
    found = packing.pack(pieces).toPandas()
    assert len(found) == 1000 and len(found.drop_duplicates(["sequence_id", "offset"])) == 1000
    assert found["sequence_id"].nunique() == -(-1000 // (2048 // int(found["length"].iloc[0])))


def test_pack_documents(odd_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 2)
    found = packing.pack_documents(odd_docs, WORD, capacity=64).toPandas()
    want = []
    for r in odd_docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 64
    assert packing.pack_documents(no_docs, WORD).count() == 0
