"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams of its lower-cased letters. Each language has a few centroids,
found by spherical k-means among its texts; the language of the centroid with the largest cosine is taken, and a text
that is far from all of them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, held_out, table
from .ngrams import hashed, parts

BITS, SIZES, CENTROIDS = 11, (2, 3), 4
#: Texts of each language that the centroids are fitted on, about; document frequencies are of all texts.
SAMPLE = 500
#: Languages that are learned, the most frequent.
LANGUAGES = 500
#: Steepness that turns cosines into a share of each language.
SHARPNESS = 25.0
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII letters and bytes of other characters stay, all else becomes a space.
_LETTERS_ONLY = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    langs: list[str]  # of the centroids
    least: float  # a cosine below this is a rejection


def counts(text: str | None) -> np.ndarray:
    """How often each n-gram occurs in the whole text."""
    data = b" ".join((text or "").lower().encode().translate(_LETTERS_ONLY).split())
    out = np.zeros(1 << BITS, np.int64)
    if not data:
        return out
    data = b" " + data + b" "
    for part in parts(data, max(SIZES)):
        for h in hashed(part, SIZES, BITS):
            out += np.bincount(h, minlength=1 << BITS)
    return out


def vectors(texts: Iterator[str | None], idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(np.array([counts(x) for x in texts], np.float32).reshape(-1, 1 << BITS)) * idf
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-9)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each n-gram how many of a task's texts have it; bucket -1: how many texts."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for frame in batches:
        for text in frame["text"]:
            total += counts(text) > 0
        n += len(frame)
    if n:
        yield pd.DataFrame({"bucket": np.arange(-1, 1 << BITS), "n": np.r_[n, total]})


def k_means(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k unit vectors; the first is the row nearest the mean, each next the one farthest from those before."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model | None:
    """labelled: id, text, lang. None if it holds no text with a letter.

    Document frequencies are counted over all of it, in tasks; about sample texts of each language, whole, become
    vectors and are gathered into centroids in tasks, a language each. The driver gets the centroids, and of each sampled
    text one number, of the languages most frequent languages at most (of equal counts the first by name): others aren't learned.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    by_lang = {r["lang"]: r["count"] for r in most.collect()}
    if not by_lang:
        return None
    df = labelled.select("text").mapInPandas(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().set_index("bucket")["n"]
    n = int(df[-1])
    idf = (np.log((1 + n) / (1 + df.drop(-1).sort_index().to_numpy())) + 0.05).astype(np.float32)

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"lang": frame["lang"], "v": [x.tobytes() for x in vectors(frame["text"], idf)]})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.array([np.frombuffer(v, np.float32) for v in sorted(frame["v"])])
        own = k_means(rows, centroids)
        return pd.DataFrame({"lang": [frame["lang"].iat[0]], "centres": [own.tobytes()], "near": [(rows @ own.T).max(axis=1).astype(np.float32).tobytes()]})

    # one pass for all languages: a row's hash against its language's share
    shares = labelled.sparkSession.createDataFrame([(lang, min(1_000_000, int(1_000_000 * sample / n) + 1)) for lang, n in by_lang.items()], "lang string, share int")
    chosen = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.col("share"))
    chosen = at_most(chosen, 2 * sample * len(by_lang))
    gathered = chosen.select("text", "lang").mapInPandas(vectorise, "lang string, v binary").groupBy("lang").applyInPandas(gather, "lang string, centres binary, near binary")
    centres, langs, nearest = [], [], []
    for r in sorted(gathered.collect(), key=lambda r: r["lang"]):
        centres.append(np.frombuffer(r["centres"], np.float32).reshape(-1, len(idf)))
        langs += [r["lang"]] * len(centres[-1])
        nearest.append(np.frombuffer(r["near"], np.float32))
    if not centres:
        return None
    least = 0.5 * float(np.quantile(np.concatenate(nearest), 0.001))
    return Model(idf, np.concatenate(centres), langs, least)


def prediction(model: Model | None, text: Column) -> Column:
    """A struct of lang_pred, score, distance and rejected."""

    @F.pandas_udf("lang_pred string, score double, distance double, rejected boolean")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array(sorted(set(model.langs)) if model else [], object)
        of = [np.flatnonzero(np.array(model.langs, object) == x) for x in names]
        for texts in batches:
            found = []
            for k in range(0, len(texts), 256):
                some = texts.iloc[k : k + 256].tolist()
                known = np.array([model is not None and x is not None and LETTER.search(x) is not None for x in some], bool)
                rows = {"lang_pred": np.full(len(some), UNKNOWN, object), "score": np.zeros(len(some)), "distance": np.ones(len(some)), "rejected": np.ones(len(some), bool)}
                if known.any():
                    cosines = vectors([x for x, y in zip(some, known, strict=True) if y], model.idf) @ model.centroids.T
                    best = np.stack([cosines[:, x].max(axis=1) for x in of], axis=1).astype(np.float64)
                    top = best.max(axis=1)
                    rows["lang_pred"][known] = names[best.argmax(axis=1)]
                    rows["score"][known] = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
                    rows["distance"][known] = 1 - top
                    rows["rejected"][known] = top < model.least
                found.append(pd.DataFrame(rows))
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"lang_pred": [], "score": [], "distance": [], "rejected": []})

    return language(text.cast("string"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, distance, rejected of each row of docs. No shuffle.

    A text that is null or has no letter is und, with score 0 and distance 1, and rejected; so is every text without a
    model. score: the language's share of all languages, by the cosines of the nearest centroids. rejected: the cosine
    is below half the least of the texts learned from (their 0.1 % quantile). Null ids stay null, repeated rows are each
    predicted, other columns are dropped whatever their names; an empty table gives an empty one.
    """
    return docs.select(F.col(id_col).alias("doc_id"), prediction(model, F.col(text_col)).alias("x")).select("doc_id", "x.*")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(learnable(docs)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "distance", "rejected")
