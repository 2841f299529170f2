"""Hard negatives against a plain search."""

import random

import numpy as np
import pytest

from lakescribe.llm import hard_negatives as h


def _plain(rows):
    """rows: (id, vector, label) that take part, ids once each."""
    ids = np.array([r[0] for r in rows])
    x = np.array([[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] for r in rows])
    labels = np.array([(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows])
    out = []
    for a in np.flatnonzero(ids % 50 == 0):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [i for i in order if labels[i] == labels[a] and ids[i] != ids[a]][:5]:
            fit = [i for i in order if labels[i] != labels[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(ids[a], ids[p], k + 1, ids[i], s[p], s[i]) for k, i in enumerate(fit)]
    return sorted(tuple(map(int, r)) for r in out)


def _found(df, **more):
    return sorted(tuple(r) for r in h.hard_negatives(df, **more).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["normal", "ties", "hot label", "near zero", "negative ids"])
def test_against_plain(spark, kind):
    rnd = random.Random(kind)
    rows = []
    for k in range(700):
        v = [rnd.gauss(0.05, 0.15) for _ in range(8)]
        if kind == "ties" and k % 3:
            v = [0.25, 0.125, 0.5, 0.0, 0.25, 0.0, 0.125, 0.25 if k % 2 else 0.3]
        if kind == "near zero":
            v = [rnd.choice([0.0, 0.0, 1 / 256, -1 / 256]) for _ in range(8)]
        rows.append((k - 350 if kind == "negative ids" else k, v, 0 if kind == "hot label" and k % 3 == 0 else rnd.randrange(10)))
    assert _found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == _plain(rows)


def test_groups_slots_and_pruning(spark, monkeypatch):
    """Anchors in many groups, rows in many slots, pairs pruned again and again: the same rows."""
    rnd = random.Random(9)
    rows = [(k, [rnd.gauss(0.1, 0.2) for _ in range(6)], k % 4) for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    x = h.packed_rows(df.select("vec_id", h.F.when(h.F.col("vec_id") % 7 == 0, (h.F.col("label") + 1) % 10).otherwise(h.F.col("label")).cast("long").alias("label"), h.F.col("embedding").alias("v")), "v", 6, h.SCALE, ("vec_id", "label"))
    found = h.mine(x, x.where("vec_id % 50 = 0"), 6, group=4, slot=200)
    assert sorted(map(tuple, found.collect())) == _plain(rows)


def test_prune_keeps_the_best():
    rng = np.random.default_rng(1)
    owner, score, other = rng.integers(0, 9, 4000), rng.integers(-20, 20, 4000), rng.permutation(4000)
    p = h.Pruned(3)
    h.HELD, held = 20, h.HELD
    try:
        for k in range(0, 4000, 37):
            p.add(owner[k : k + 37], score[k : k + 37], other[k : k + 37])
        got = sorted(zip(*map(np.ndarray.tolist, p.all()), strict=True))
    finally:
        h.HELD = held
    want = [(o, s, i) for o in range(9) for s, i in sorted(((int(s), int(i)) for q, s, i in zip(owner, score, other, strict=True) if q == o), key=lambda r: (-r[0], r[1]))[:3]]
    assert got == sorted(want)


def test_keys_sort_as_scores():
    rnd = random.Random(4)
    pairs = [(rnd.choice([-(2**62), -1, 0, 5, 2**62]), rnd.choice([-(2**62), -3, 0, 3, 2**62]), rnd.choice([-7, 0, 7])) for _ in range(300)]
    blob = h.keys(*(np.array(c, np.int64) for c in zip(*pairs, strict=True)), 1)
    single = sorted(blob[k : k + h.KEY_SIZE] for k in range(0, len(blob), h.KEY_SIZE))
    assert [h.read_key(k)[:3] for k in single] == sorted(pairs, key=lambda r: (r[0], -r[1], r[2]))


def test_scores_are_exact():
    a, b = np.array([[2**27, -(2**27)]], "<i4"), np.array([[2**27 - 1, 2**27 - 3]], "<i4")
    assert h.scores(a, b).tolist() == [[2**28]] and h.scores(a, a).tolist() == [[2**55]]


def test_odd_rows(spark):
    rnd = random.Random(6)
    good = [(k, [rnd.gauss(0.1, 0.2) for _ in range(6)], k % 3) for k in range(300)]
    odd = [(400, None, 1), (401, [0.5] * 5 + [None], 1), (402, [0.5] * 5 + [float("nan")], 1), (403, [float("inf")] * 6, 1), (404, [0.9] * 6, None), (None, [0.9] * 6, 1), (450, [0.9] * 5, 1), (500, [1e20] * 6, 1)]
    df = spark.createDataFrame([(*r, 5, 6, "x") for r in good + odd], SCHEMA + ", rank int, anchor_id int, x string")
    assert _found(df) == _plain(good)
    assert h.hard_negatives(df.where("false")).count() == 0 and h.hard_negatives(df.where("vec_id = 50")).count() == 0
    # a repeated anchor is one anchor, the one of the least label; its other row is no partner of its own id
    twice = [*good, (50, [0.3] * 6, 9)]
    own = [r for r in _found(spark.createDataFrame(twice, SCHEMA)) if r[0] == 50]
    assert own == [r for r in _plain(good) if r[0] == 50]
