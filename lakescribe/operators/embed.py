"""Vectors of texts by any function, and what still has none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

WIDTH, BATCH, MOST_BATCH, DOCUMENT_CHARACTERS, QUESTION_CHARACTERS = 64, 10, 25, 8000, 2000


def hashing_embedder(texts: list[str], width: int = WIDTH) -> list[list[float]]:
    """Counts of hashed words with signs, of length 1. Needs no model and no network, and is the same everywhere."""
    out = []
    for text in texts:
        v = np.zeros(width)
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % width] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed_column(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = BATCH, most: int = DOCUMENT_CHARACTERS, width: int = WIDTH) -> DataFrame:
    """df with embedding: white space collapsed, cut at most characters, batch texts at a call, order kept.

    A call that gives another number of vectors, or one of another width or with values that aren't finite, fails the job.
    Null texts have no embedding.
    """
    batch = min(max(1, batch), MOST_BATCH)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            known = [k for k, x in enumerate(values) if x is not None]
            out: list[list[float] | None] = [None] * len(values)
            for b in range(0, len(known), batch):
                some = known[b : b + batch]
                vectors = embed([values.iloc[k] for k in some])
                if len(vectors) != len(some) or any(len(v) != width or not np.isfinite(v).all() for v in vectors):
                    raise ValueError("the embedder gave vectors of the wrong number, width or value")
                for k, v in zip(some, vectors, strict=True):
                    out[k] = v
            yield pd.Series(out, dtype=object)

    return df.withColumn("embedding", run(F.substring(collapse(F.col(text)), 1, most)))


def backlog(chunks: DataFrame, most: int, order: str = "created_at", key: str = "chunk_id") -> DataFrame:
    """The oldest chunks without a vector, most of them at a time."""
    return chunks.where("embedding is null").orderBy(order, key).limit(most)
