"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature says whether a hashed n-gram of the lower-cased text's bytes occurs in the whole text. Over the labelled texts
its log-count ratio r is the logarithm of how much more often toxic texts have it; the features that tell the classes
apart best are kept, each as r or 0, and a logistic regression is trained on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, bounded_sample, cut_lineage, held_out, table
from .ngrams import hashed, parts

BITS, SIZES, FEATURES, SMOOTHING = 18, (3, 4, 5, 6), 4096, 1.0
#: Labelled texts of each kind that the classifier is fitted on, about.
TOXIC, CLEAN = 2_000, 4_000
ROUNDS, RATE, DECAY = 250, 0.05, 1e-4
THRESHOLD = 0.3
#: Tasks that count n-grams of the labelled texts; each gives up to 2^BITS sums.
COUNTERS = 12


def _present(text: str | None, table: np.ndarray) -> np.ndarray:
    """table's values (-1: none) for the n-grams of the text, each once."""
    data, found = b" " + (text or "").lower().encode() + b" ", []
    for part in parts(data, max(SIZES)):
        for h in hashed(part, SIZES, BITS):
            x = table[h]
            found.append(x[x >= 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, table.dtype)


class Model(NamedTuple):
    numbers: np.ndarray  # of each hash: its feature's number, or -1
    weights: np.ndarray  # of each feature: weight times log-count ratio
    bias: float


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """bucket, toxic, clean: how many of a task's texts of each kind have an n-gram."""
    every, sums = np.arange(1 << BITS), np.zeros((2, 1 << BITS), np.int64)
    for frame in batches:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            sums[int(toxic)][_present(text, every)] += 1
    some = np.flatnonzero(sums.sum(axis=0))
    if len(some):
        yield pd.DataFrame({"bucket": some, "toxic": sums[1][some], "clean": sums[0][some]})


def log_count_ratio(toxic, clean, n_toxic: int, n_clean: int):
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


def regression(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        d = (0.5 * (1 + np.tanh(0.5 * (x @ w + b))) - y).astype(np.float32) / len(y)
        g, gb = x.T @ d + DECAY * w, float(d.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, features: int = FEATURES) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic, both to learn from. None if a kind has no text.

    About so many labelled texts of each kind, whole, chosen by a hash of the id: a bound that holds at any size, and so
    does what follows from it. n-grams are counted in COUNTERS tasks and summed by bucket; the sums of the features kept
    and their numbers in each of these texts reach the driver, no text does.
    """
    labels = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = None
    for kind, bound in ((1, toxic), (0, clean)):
        own = labels.where(F.col("toxic") == kind)
        own = bounded_sample(own, bound, "doc_id")
        some = own if some is None else some.unionByName(own)
    chosen = at_most(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), 4 * (toxic + clean))
    chosen = cut_lineage(chosen.select("text", "toxic").repartition(COUNTERS))
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    sums = chosen.mapInPandas(_count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n[0] + n[1]))
    apart = F.abs(F.col("toxic") / F.lit(float(n[1])) - F.col("clean") / F.lit(float(n[0]))) / F.sqrt(share * (1.0001 - share))
    kept = sums.where("toxic + clean >= 3").withColumn("apart", apart).orderBy(F.desc("apart"), "bucket").limit(features).toPandas()
    if not len(kept):
        return None
    ratio = log_count_ratio(kept["toxic"].to_numpy(), kept["clean"].to_numpy(), n[1], n[0]).astype(np.float32)
    numbers = np.full(1 << BITS, -1, np.int32)
    numbers[kept["bucket"].to_numpy()] = np.arange(len(kept))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"toxic": frame["toxic"], "x": [_present(x, numbers).astype("<i2").tobytes() for x in frame["text"]]})

    rows = chosen.mapInPandas(present, "toxic int, x binary").collect()
    x = np.zeros((len(rows), len(kept)), np.float32)
    for k, r in enumerate(rows):
        own = np.frombuffer(r["x"], "<i2")
        x[k, own] = ratio[own]
    weights, bias = regression(x, np.array([r["toxic"] for r in rows], np.float32))
    return Model(numbers, weights * ratio, bias)


def score(model: Model | None, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [model.bias + model.weights[_present(x, model.numbers)].sum() if model else -np.inf for x in texts]
            yield pd.Series(0.5 * (1 + np.tanh(0.5 * np.array(out, np.float64))))

    return scores(text.cast("string"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row of docs: how likely the text is toxic. No shuffle.

    Null text counts as empty and is scored like any. Without a model every score is 0. Null ids stay null, repeated
    rows are each scored, other columns are dropped whatever their names; an empty table gives an empty one.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    apart = held_out("doc_id", 4, 2)
    found = predict(docs, fit(docs.where(~apart), labels.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted")
