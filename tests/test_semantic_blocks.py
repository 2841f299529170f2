"""Search by blocks is the search of all pairs, and leaves blocks out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.operators import semantic

SCHEMA = "vec_id long, embedding array<float>, scope string"


def _plain(questions, vectors, k):
    out = set()
    unit = lambda x: np.asarray(x, float) / max(np.linalg.norm(np.asarray(x, float)), 1e-12)
    for q, e, s in questions:
        near = [(round(float(unit(e) @ unit(v)), 12), i) for i, v, t in vectors if t == s and v is not None]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:k])}
    return out


def _tables(kind, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16))
    rows = []
    for k in range(2000):
        v = centers[k % 12] + rng.normal(size=16) * (0.05 if kind == "gathered" else 3)
        v = v.astype(np.float32)
        if kind == "odd":
            v = np.zeros(16, np.float32) if k % 40 == 0 else rows[k - 1][1] if k % 3 == 1 else v
        rows.append((k, v, "hot" if k % 3 else f"s{k % 5}"))
    rows = [(k, [float(x) for x in v], s) for k, v, s in rows]
    questions = [(k, rows[k][1] if k % 2 else [float(np.float32(x)) for x in rng.normal(size=16)], rows[k][2]) for k in range(0, 2000, 67)]
    if kind == "odd":
        questions += [(9001, [0.0] * 16, "hot"), (9002, rows[5][1], "nowhere")]
    return questions, rows


@pytest.mark.parametrize("kind", ["gathered", "spread", "odd"])
def test_equal_to_all_pairs(spark, kind):
    questions, rows = _tables(kind)
    q = spark.createDataFrame([(*r,) for r in questions], SCHEMA.replace("vec_id", "query_id"))
    v = spark.createDataFrame([*rows, (9999, None, "hot")], SCHEMA)
    found = semantic.search(q, v, 7, "scope").select("query_id", "vec_id", "rank").collect()
    assert {tuple(r) for r in found} == _plain(questions, rows, 7)


def test_split_blocks_and_grouped_questions(spark):
    questions, rows = _tables("gathered", 3)
    q, v = spark.createDataFrame(questions, SCHEMA.replace("vec_id", "query_id")), spark.createDataFrame(rows, SCHEMA)
    near, _ = semantic.search_blocks(q, v, 5, "scope", most=8, split=40, group=6)
    best = semantic.topk.per_group(near, ["query_id"], [F.desc(F.round("similarity", 12)), F.col("vec_id")], 5)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in best.collect()} == _plain(questions, rows, 5)


def test_blocks_are_left_out(spark):
    questions, rows = _tables("gathered")
    q, v = spark.createDataFrame(questions, SCHEMA.replace("vec_id", "query_id")), spark.createDataFrame(rows, SCHEMA)
    pairs = semantic.search_blocks(q, v, 5, "scope")[1]
    looked = pairs.agg(F.sum(F.when(F.col("searched"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    assert looked < 0.35  # of all pairs in scope


def test_many_questions_without_a_scope(spark):
    questions, rows = _tables("gathered", 5)
    q, v = spark.createDataFrame([(k, e, "a") for k, e, _ in questions], SCHEMA.replace("vec_id", "query_id")), spark.createDataFrame([(k, e, "a") for k, e, _ in rows], SCHEMA)
    want = _plain([(k, e, "a") for k, e, _ in questions], [(k, e, "a") for k, e, _ in rows], 3)
    for block in (5, 2000):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in semantic.search(q.drop("scope"), v.drop("scope"), 3, block=block).collect()} == want
    assert semantic.search(q.where("false"), v, 3, "scope").count() == 0 and semantic.search(q, v.where("false"), 3, "scope").count() == 0


def test_memory_does_not_grow_with_questions():
    """A batch of vectors meets many questions in tiles: the same neighbours, and not all similarities at once."""
    import tracemalloc

    rng = np.random.default_rng(1)
    matrix, x = semantic._unit(rng.normal(size=(6000, 8))), semantic._unit(rng.normal(size=(5000, 8)))
    ids = np.arange(5000) * 3
    tracemalloc.start()
    parts = list(semantic._best(matrix, x, ids, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 5000 * 8 / 2
    rows, columns = semantic._nearest(matrix @ x.T, ids, 4)
    assert (np.concatenate([p[0] for p in parts]) == rows).all() and (np.concatenate([p[1] for p in parts]) == columns).all()
