"""The whole retrieval job: scope, both lanes, masked questions, required documents, nothing found."""

import pytest

from lakescribe.operators import jobs, pii

SECRET = "a secret of thirty-two characters, for tests only"
LONG = "and some more words so that it is long enough"


@pytest.fixture(scope="module")
def tables(spark):
    files = [
        (1, "c", "u", "plain.txt", "ready", "standard"), (2, "c", "u", "letters.txt", "ready", "privacy_minimised"), (3, "c", "other", "theirs.txt", "ready", "standard"),
        (4, "c", "u", "late.txt", "processing", "standard"), (5, "c", "u", "vectors.txt", "ready", "standard"), (6, "d", "u", "else.txt", "ready", "standard"), (7, "e", "u", "alone.txt", "ready", "standard"),
    ]
    texts = [
        (10, 1, 0, f"rivers carry stones to the harbour {LONG}", [1.0, 0.0, 0.0]), (11, 1, 1, f"nothing of the kind is said here {LONG}", [0.0, 1.0, 0.0]), (12, 1, 2, f"Rivers carry stones, to the harbour {LONG}", [0.0, 0.0, 1.0]),
        (20, 2, 0, f"write to ann@example.org about the rivers {LONG}", [0.0, 1.0, 0.1]), (21, 2, 1, f"write to bob@example.org about the hills {LONG}", [0.0, 1.0, 0.2]),
        (30, 3, 0, f"rivers carry stones to the harbour {LONG}", [1.0, 0.0, 0.0]), (40, 4, 0, f"rivers carry stones to the harbour {LONG}", [1.0, 0.0, 0.0]),
        (50, 5, 0, f"quite other words stand in this one {LONG}", [1.0, 0.05, 0.0]), (60, 6, 0, f"rivers carry stones to the harbour {LONG}", [1.0, 0.0, 0.0]), (70, 7, 0, "short", None), (71, 7, 1, f"one {LONG}", None),
    ]
    d = spark.createDataFrame(files, "document_id long, collection_id string, user_id string, filename string, status string, processing_mode string")
    c = spark.createDataFrame(texts, "chunk_id long, document_id long, chunk_index int, content string, embedding array<double>").join(d.select("document_id", "collection_id"), "document_id")
    c = pii.project_chunks(c, d.drop("filename", "status"), SECRET).drop("user_id", "processing_mode")
    return c, d


def _ask(spark, tables, rows, **more):
    q = spark.createDataFrame([(*r, None)[:6] if len(r) == 5 else r for r in rows], "query_id long, user_id string, collection_id string, question string, embedding array<double>, document_ids array<long>")
    found, missing = jobs.retrieve(q, *tables, SECRET, **more)
    out = {}
    for r in found.orderBy("query_id", "final_rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["retrieval_mode"], r["reason"]))
    return out, sorted(map(tuple, missing.collect()))


def test_lanes_and_scope(spark, tables):
    out, missing = _ask(spark, tables, [(1, "u", "c", "stones in the harbour", [1.0, 0.0, 0.0]), (2, "other", "c", "stones in the harbour", [1.0, 0.0, 0.0]), (3, "nobody", "c", "stones", [1.0, 0.0, 0.0])])
    ids = [x[0] for x in out[1]]
    assert ids[0] == 10 and {30, 40, 60} & set(ids) == set() and 12 not in ids  # another's, one not ready, another collection's; a repeat
    assert (50, "semantic", "hybrid_match") in out[1] and out[1][0][1] == "hybrid"  # only its vector is near
    assert [x[0] for x in out[2]] == [30] and 3 not in out and missing == []


def test_private_documents_by_masked_words(spark, tables):
    out, _ = _ask(spark, tables, [(1, "u", "c", "what of ann@example.org", [0.0, 0.0, -1.0])])
    assert (20, "hybrid", "hybrid_match") in out[1]  # found by words too, as its masked text has the address's pseudonym
    assert dict((x[0], x[1]) for x in out[1]).get(21, "semantic") == "semantic"  # bob's isn't
    out, _ = _ask(spark, tables, [(2, "u", "c", "letters txt", [0.0, 0.0, -1.0])])
    assert all(mode != "hybrid" for x, mode, _ in out[2] if x in (20, 21))  # a private document isn't found by its name


def test_required_documents(spark, tables):
    rows = [(1, "u", "c", "rivers stones harbour", [1.0, 0.0, 0.0], [1, 5]), (2, "u", "c", "rivers", [0.0, 1.0, 0.0], [2]), (3, "u", "c", "rivers", [1.0, 0.0, 0.0], [1, 4])]
    out, missing = _ask(spark, tables, rows, limit=2)
    assert {x[0] for x in out[1]} == {10, 50} and {x[0] for x in out[2]} <= {20, 21} and missing == [(3, 4)]


def test_nothing_found(spark, tables):
    out, _ = _ask(spark, tables, [(1, "u", "e", "zebra", None), (2, "u", "nowhere", "zebra", None)])
    assert out == {1: [(70, "keyword", "broad_context_fallback"), (71, "keyword", "broad_context_fallback")]}


def test_both_fusions(spark, tables):
    rows = [(1, "u", "c", "stones in the harbour", [1.0, 0.0, 0.0])]
    by_rank, by_score = (_ask(spark, tables, rows, mode=m)[0][1] for m in ("rrf", "weighted"))
    assert by_rank[0][0] == by_score[0][0] == 10 and {x[0] for x in by_rank} == {x[0] for x in by_score}
