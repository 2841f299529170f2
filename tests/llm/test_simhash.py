"""Near-duplicates against brute force."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from lakescribe.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({k: k + 32 for k in range(65, 91)}).translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance=3):
    """The least index that each is connected with."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(fps))]


def test_fingerprint(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"]) == brute_fingerprint(r["text"])
    assert simhash.fingerprint("A b\x0bC\x1cd É") == brute_fingerprint("A b\x0bC\x1cd É")


def _clusters(n, seed):
    """Fingerprints in chains and balls, and loose ones."""
    rnd = random.Random(seed)
    out = [0]
    for _ in range(n):
        base = rnd.getrandbits(64) if rnd.random() < 0.4 else rnd.choice(out)
        for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 3, 4, 5])):
            base ^= 1 << b
        out.append(base)
    return sorted(set(out))


def test_links_and_components(spark):
    for seed, most in ((1, 4096), (2, 24)):
        fps = _clusters(150, seed)
        if most < 4096:  # a ball whose buckets must be split
            fps = sorted({*fps, *(12345 ^ 1 << a ^ 1 << b for a in range(38, 64, 2) for b in range(39, 64, 3))})
        df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").repartition(3)
        roots = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(df, most=most)).collect()}
        own = {x: roots.get(x, simhash._signed(x)) for x in fps}
        want = brute_classes(fps)
        groups, wanted = {}, {}
        for k, x in enumerate(fps):
            groups.setdefault(own[x], set()).add(x)
            wanted.setdefault(want[k], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)] + [(900, 900), (905, 901)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(401)) and roots[905] == 901


def test_star_with_the_largest_hub(spark):
    edges = spark.createDataFrame([(1000, k) for k in range(1, 101)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {1}


def test_hot_bucket_gives_a_forest():
    rng = np.random.default_rng(1)
    ball = np.unique(rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    edges = simhash.forest(ball, np.bitwise_count(ball[:, None] ^ simhash.pivots()[None, :]).astype(np.int8), 3)
    assert len(edges) == len(ball) - 1


def test_classes(odd_docs, no_docs):
    found = simhash.classes(odd_docs).collect()
    rows = odd_docs.collect()
    assert len(found) == len(rows)
    fps = [brute_fingerprint(r["text"]) for r in rows]
    classes = brute_classes(fps)
    want = []
    for k, r in enumerate(rows):
        ids = [x["doc_id"] for x, c in zip(rows, classes, strict=True) if c == classes[k] and x["doc_id"] is not None]
        want.append((r["doc_id"], simhash._signed(fps[k]), min(ids, default=None)))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(c) for _, _, c in want})
    assert simhash.classes(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0
