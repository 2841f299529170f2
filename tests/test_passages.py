"""Support of passages: held against all where a chunk is read, or met by rare words."""

import random

from lakescribe.operators import evaluate


def test_both_ways_without_shuffle(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["river", "stone", "Harbour", "hill's", "of", "north", "south", "lamp", "été"])
    text = lambda n: " ".join(word() for _ in range(rnd.randrange(n)))
    c = spark.createDataFrame([(k, text(12) if k % 20 else None) for k in range(200)], "chunk_id long, content string")
    p = spark.createDataFrame([(f"p{k % 35}x{k}", text(7) if k % 9 else None) for k in range(40)], "passage_id string, text string")
    held = evaluate.passage_support(c, p, 0.6)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evaluate, "SENT", 3)
    met = evaluate.passage_support(c, p, 0.6)
    rows = sorted(map(tuple, held.collect()))
    assert rows and rows == sorted(map(tuple, met.collect()))
