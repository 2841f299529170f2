"""Held-out accuracy of the three classifiers, and odd rows."""

import os

import numpy as np
import pytest

from lakescribe.llm import language_id, pu_quality, toxicity
from lakescribe.llm.common import at_most, bounded_sample

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")


@given
def test_language(spark):
    found = language_id.op7_language_id(spark, SF).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    out = found[found["held_out"]]
    assert (out["lang_pred"] == lang[out.index]).mean() > 0.97
    assert found["score"].between(0, 1).all()


@given
def test_quality(spark):
    found = pu_quality.op6_pu_quality(spark, SF).toPandas().set_index("doc_id")
    both = found[found["held_out"]].join(_labels(spark), how="inner")
    assert (both["predicted"] == both["quality"]).mean() > 0.93
    assert found["score"].between(0, 1).all()


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the given tables aren't here")
def test_toxicity(spark):
    """Of the larger tables, as the smaller ones hold out 14 toxic texts only."""
    found = toxicity.op8_toxicity(spark, LARGER).toPandas().set_index("doc_id")
    both = found[found["held_out"]].join(spark.read.parquet(f"{LARGER}/labels.parquet").toPandas().set_index("doc_id"), how="inner")
    caught, flagged = both[both["toxic"] == 1]["predicted"].mean(), both[both["predicted"] == 1]["toxic"].mean()
    assert caught > 0.7 and flagged > 0.85, (caught, flagged)
    assert found["score"].between(0, 1).all()


def test_samples_are_bounded(spark):
    """Ids that repeat don't make a sample larger than its bound says."""
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) AS doc_id", "'a text of a few words' AS text", "'en' AS lang")
    for bound in (10, 300):
        assert bounded_sample(docs, bound, "doc_id").count() <= 3 * bound
    assert at_most(docs, 100).count() <= 200 and at_most(docs, 4000).count() == 4000
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "if(id % 3 = 0, 1, 0) AS toxic")
    assert pu_quality.fit(docs, labels, 50, 50) is not None and language_id.fit(docs, 20) is not None and toxicity.fit(docs, labels, 20, 20) is not None


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good = lambda n: np.c_[rng.normal(2, 1, (n, 3)), np.zeros((n, 1))]
    bad = lambda n: np.c_[rng.normal(-2, 1, (n, 3)), np.zeros((n, 1))]
    model = pu_quality.train(good(1500), np.concatenate([good(1800), bad(1200)]), rounds=200)
    assert abs(model.prior - 0.6) < 0.1
    score = lambda x: pu_quality._sigmoid(pu_quality._forward(pu_quality._scaled(x, model.mean, model.scale), model.weights)[1])
    assert (score(good(500)) > 0.5).mean() > 0.95 and (score(bad(500)) < 0.5).mean() > 0.95


def test_centroids():
    rows = np.eye(6, dtype=np.float32)[[0, 0, 1, 1, 5, 5]]
    assert np.allclose(sorted(language_id.k_means(rows, 3).argmax(axis=1)), [0, 1, 5])
    assert (language_id.counts("ab" * (1 << 20)) == language_id.counts("ab" * (1 << 20))).all()


def test_odd_rows(spark, odd_docs, no_docs):
    n = odd_docs.count()
    labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = language_id.fit(odd_docs)
    found = language_id.predict(odd_docs, model).collect()
    assert len(found) == n
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2, 3, 11)) for r in found if r["doc_id"] is not None)
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}
    for model in (pu_quality.fit(odd_docs, labels), None):
        scores = [r["score"] for r in pu_quality.predict(odd_docs, model).collect()]
        assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    for model in (toxicity.fit(odd_docs, labels), None):
        scores = [r["score"] for r in toxicity.predict(odd_docs, model).collect()]
        assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    assert language_id.fit(no_docs) is None and pu_quality.fit(no_docs, labels) is None and toxicity.fit(no_docs, labels) is None
    assert language_id.predict(no_docs, None).count() == pu_quality.predict(no_docs, None).count() == toxicity.predict(no_docs, None).count() == 0


def test_toxic_word_in_a_long_text(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), 6))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(int(rng.integers(20, 200)))]
        if k % 4 == 0:
            words[int(rng.integers(len(words)))] = "grumblefitz"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = spark.createDataFrame([(0, " ".join(word() for _ in range(3000)) + " GRUMBLEFITZ!!"), (1, " ".join(word() for _ in range(3000)))], "doc_id long, text string")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.predict(tests, model).collect()}
    assert found == {0: 1, 1: 0}


def test_languages_are_bounded(spark):
    """Only the most frequent languages are learned, however many values a dirty column has."""
    rows = [(k, f"some words of language {'abcdefgh'[k % 8] * 6} and more", f"l{k % 8}") for k in range(200)] + [(1000 + k, f"dirty words {k}", f"x{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from lakescribe.llm import language_id

    assert sorted(set(language_id.fit(df, languages=8).langs)) == [f"l{k}" for k in range(8)]
