"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk, trusted positives, an estimated prior.

Texts become a few shares and averages (kinds of bytes, words, lines) and a normalised vector of hashed byte n-grams, which
says what they are about and whether it reads like what is trusted. Trusted positives and unlabelled web text, both
bounded samples, train a small network on the risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
whose second part is the risk of the negatives, which nobody labelled; where it falls below zero the step goes the other
way. The prior is the least ratio of the shares of unlabelled and of positive texts above a threshold of a first
classifier that tells the two apart: no part of the positives' mass can be rarer than that among the unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, bounded_sample, held_out, table
from .ngrams import hashed, parts

POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, ROUNDS, RATE, SEED = 16, 400, 0.02, 7
THRESHOLD = 0.3
#: Hashed n-grams: sizes, bits of the hash, and how many are a small number of them.
SIZES, BITS, FEW = (3, 4), 8, 3000

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>[]{}()", b"/\\@_=+~^`", b":;'\"-", bytes(range(128, 192)), bytes(range(192, 256))]
_KIND = np.full(256, len(_KINDS))
for _k, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _k


def shares(text: str | None) -> list[float]:
    """Shares and averages of a whole text. Without words: all 0 but the last, which says so."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * (len(_KINDS) + 9) + [1.0]
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=len(_KINDS) + 1)[: len(_KINDS)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, distinct = len(words), len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *(kinds / len(data)).tolist(),
        np.log1p(n),
        sum(map(len, words)) / n,
        distinct / n,
        np.log1p(n) - np.log1p(distinct),
        again / n,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        kinds[10] / n,
        kinds[9] / n,
        0.0,
    ]


N_SHARES = len(_KINDS) + 10
N_FEATURES = N_SHARES + (1 << BITS)


def grams(text: str | None) -> np.ndarray:
    """The hashed n-grams of a whole text's lower-cased bytes: roots of their shares; of an empty text zeros.

    FEW more that are none are counted, so a short text, whose shares are mostly chance, has less to say by them.
    """
    data, out = (text or "").lower().encode(), np.zeros(1 << BITS)
    for part in parts(data, max(SIZES)) if data else ():
        for h in hashed(part, SIZES, BITS):
            out += np.bincount(h, minlength=1 << BITS)
    return np.sqrt(out / (out.sum() + FEW))


def features(texts: Iterator[str | None]) -> np.ndarray:
    """A row for each text: shares, then n-grams."""
    return np.array([np.concatenate([shares(x), grams(x)]) for x in texts], np.float32).reshape(-1, N_FEATURES)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]  # of the network: to the hidden units, their bias, to the output, its bias
    prior: float


def _scaled(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / scale, -6, 6).astype(np.float32)


def _forward(x: np.ndarray, w: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, hidden @ w[2] + w[3]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _train(x: np.ndarray, slopes, rounds: int, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Adam over all rows. slopes(outputs): the risk's derivative by each row's output."""
    rng = np.random.default_rng(SEED)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    w = [a.astype(np.float32) for a in w]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, rounds + 1):
        hidden, out = _forward(x, tuple(w))
        d = slopes(out).astype(np.float32)
        back = np.outer(d, w[2]) * (1 - hidden**2)
        grads = [x.T @ back + decay * w[0], back.sum(axis=0), hidden.T @ d + decay * w[2], d.sum()]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return tuple(np.asarray(a) for a in w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From the scores of texts that the classifier wasn't trained on: least ratio of shares above a threshold, positives'
    share at least a half. A tenth of the ratio's own error is added; the result lies between one text and 0.99 of all."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0, 0.5, 51))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = 1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p))
    return float(np.clip(((above_u + 0.1 * slack) / above_p).min(), 1 / len(u), 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = ROUNDS) -> Model:
    rows = np.concatenate([positive, unlabelled])
    mean, scale = rows.mean(axis=0, dtype=np.float64), np.maximum(rows.std(axis=0, dtype=np.float64), 1e-3)
    scale[N_SHARES:N_FEATURES] *= 2 * np.sqrt((1 << BITS) / N_SHARES)  # all n-grams together weigh half as much as all shares
    p, u = _scaled(positive, mean, scale), _scaled(unlabelled, mean, scale)
    # Positive or unlabelled? Trained on every other row, the rest give the prior.
    a, b = p[::2], u[::2]
    x, is_p = np.concatenate([a, b]), np.r_[np.ones(len(a), bool), np.zeros(len(b), bool)]
    share = np.where(is_p, 0.5 / max(len(a), 1), 0.5 / max(len(b), 1))
    first = _train(x, lambda out: share * (_sigmoid(out) - is_p), rounds // 2)
    rest_p, rest_u = (p[1::2] if len(p) > 1 else p), (u[1::2] if len(u) > 1 else u)
    prior = estimate_prior(_forward(rest_p, first)[1], _forward(rest_u, first)[1])
    return Model(mean, scale, _train(np.concatenate([p, u]), lambda out: risk_slopes(out, len(p), prior), rounds), prior)


def risk_slopes(out: np.ndarray, n: int, prior: float) -> np.ndarray:
    """The risk's derivative by each output, of n positives and then the unlabelled, with the logistic loss.

    Where the negatives' part is below zero it is the derivative of the way back to zero instead.
    """
    s = _sigmoid(out)
    plus, minus_p, minus_u = (s[:n] - 1) / n, s[:n] / n, s[n:] / (len(out) - n)
    negatives = np.logaddexp(0, out[n:]).mean() - prior * np.logaddexp(0, out[:n]).mean()
    if negatives >= 0:
        return np.concatenate([prior * plus - prior * minus_p, minus_u])
    return np.concatenate([prior * minus_p, -minus_u])


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"x": [x.tobytes() for x in features(frame["text"])]})


def _rows(texts: DataFrame) -> np.ndarray:
    return np.array([np.frombuffer(r["x"], np.float32) for r in texts.select("text").mapInPandas(_featurise, "x binary").collect()]).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """docs: doc_id, text to learn from; labels: doc_id, quality. None without a trusted positive or a text.

    Positives are about so many of the rows of docs whose label is 1, unlabelled about so many of all rows of docs: both
    bounds, at most doubled (positives: four times) by ids that repeat, hold at any size. Texts become features where they
    are read, and only features of these rows reach the driver. Labels of 0 are never used.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    p = _rows(at_most(docs.join(F.broadcast(bounded_sample(good, positives, "doc_id")), "doc_id", "left_semi"), 4 * positives))
    u = _rows(bounded_sample(docs, unlabelled, "doc_id"))
    return train(p, u) if len(p) and len(u) else None


def score(model: Model | None, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = features(texts)
            yield pd.Series(_sigmoid(_forward(_scaled(rows, model.mean, model.scale), model.weights)[1].astype(np.float64)) if model else np.full(len(rows), 0.5))

    return scores(text.cast("string"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row of docs: how likely its quality is 1. No shuffle.

    Null text counts as empty and is scored like any. Without a model every score is 0.5. Null ids stay null, repeated
    rows are each scored, other columns are dropped whatever their names; an empty table gives an empty one.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learnable(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.where(~held_out("doc_id", 5, 0)).select("doc_id", "text"), labels.where(~held_out("doc_id", 5, 0)).select("doc_id", "quality")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(*learnable(docs, table(spark, sf_dir, "labels"))))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
