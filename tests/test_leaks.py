"""Leaks by one automaton a scope are those of looking for each identifier."""

import random
import time

from lakescribe.operators import pii


def test_equal_to_contains(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("ab1 ") for _ in range(n))
    payloads = [(rnd.choice(["x", "x", "y", "z", None]), word(rnd.randrange(30)) if k % 20 else None) for k in range(300)]
    known = [(rnd.choice(["x", "y", "w", None]), word(rnd.randrange(5)) if k % 20 else None) for k in range(120)]
    want = sorted({(s, v) for s, v in known if s and v and any(t is not None and v in t for q, t in payloads if q == s)})
    p, i = spark.createDataFrame(payloads, "scope_id string, text string"), spark.createDataFrame(known, "scope_id string, value string")
    for most in (20_000, 10):
        assert sorted(map(tuple, pii.leaks(p, i, most=most).collect())) == want
    assert pii.leaks(p.where("false"), i).count() == 0 and pii.leaks(p, i.where("false")).count() == 0


def test_many_identifiers(spark):
    """A scope with 100,000 identifiers: payloads are read once."""
    i = spark.range(100_000).selectExpr("'s' AS scope_id", "concat('id-', id * 7919, '-end') AS value")
    p = spark.range(2000).selectExpr("'s' AS scope_id", "concat(repeat('some words go here ', 20), 'id-', id * 7919 * 60, '-end') AS text")
    began = time.time()
    assert pii.leaks(p, i).count() == 1667
    assert time.time() - began < 30


def test_only_some_rules(spark):
    """A card that swallows the end of an address takes its place, unless addresses alone are asked for."""
    d = spark.createDataFrame([("see 38.211.12.42 4366089147969128 of a@b.org",)], "text string")
    found = lambda **more: [x.rule_id for x in d.select(pii.detect(d.text, **more).alias("x")).first().x]
    assert found() == ["payment_card_luhn", "email"]
    assert found(only=("email", "ipv4")) == ["ipv4", "email"]


def test_a_card_beside_other_digits(spark):
    """With digits beside it a card is no candidate and isn't masked; where it also stands alone it is known, so it has leaked."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("x", "4845168114407329 is mine, 4845168114407329 5 too"), ("y", "4845168114407329 is mine")], "scope_id string, text string")
    masked = d.select("scope_id", pii.mask(d.text, d.scope_id, "a secret of thirty-two characters, for tests only").alias("text"))
    known = d.select("scope_id", F.explode(pii.detect(d.text)).alias("x")).select("scope_id", "x.*")
    assert list(map(tuple, pii.leaks(masked, known).collect())) == [("x", "4845168114407329")]
