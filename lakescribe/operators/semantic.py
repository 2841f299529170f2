"""Search by vectors: exact cosine similarity, in blocks of directions of which most need no look.

Vectors fall into blocks by the nearest of a few centroids, in each scope apart. The angle between a question and a vector
is at least that between question and centroid less the block's widest angle, so a block's best possible similarity is
known before any of its vectors is seen. A question first looks into the blocks that promise most, until they hold k
vectors; the k-th similarity it finds there is what another block must be able to reach to be looked at. In a block
questions and vectors meet as matrices; large blocks are split, and large sets of questions are taken in groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import topk

#: Questions that go to every task as one matrix; more, or such with a scope, are searched by blocks.
BLOCK = 2_000
#: Centroids, the vectors that they are learned from, vectors of a split, questions of a group: at most, or about.
CENTROIDS, SAMPLE, SPLIT, GROUP = 64, 10_000, 50_000, 20_000
#: Similarities this near may be equal, and how far a bound may be off by rounding.
TIE, SLACK = 1e-11, 1e-7
#: Similarities that are held at once, or those of one question, in each task.
TILE = 4_000_000


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(similar: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest values of each row; rounded for the order alone, so equal vectors tie and the id decides."""
    if similar.shape[1] <= k:
        return np.indices(similar.shape).reshape(2, -1)
    least = np.partition(similar, -k, axis=1)[:, -k] - TIE  # all that ties with the k-th is looked at
    rows, columns = np.nonzero(similar >= least[:, None])
    order = np.lexsort((ids[columns], -similar[rows, columns].round(12), rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _best(matrix: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Questions, vectors and similarities of the k nearest of these vectors to each question, some questions at a time."""
    step = max(1, TILE // max(1, len(x)))
    for at in range(0, len(matrix), step):
        similar = matrix[at : at + step] @ x.T
        rows, columns = _nearest(similar, ids, k)
        yield rows + at, columns, similar[rows, columns]


def centroids(vectors: DataFrame, most: int = CENTROIDS, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions that a bounded sample of the vectors gathers around; none if all are zero. Any directions give right results."""
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("centroids")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)))) if n > sample else vectors
    rows = some.select("vec_id", "embedding").limit(2 * sample).orderBy("vec_id").toPandas()["embedding"]
    if not len(rows):
        return np.zeros((0, 1))
    x = _unit(rows)
    x = x[np.linalg.norm(x, axis=1) > 0.5]
    if not len(x):
        return np.zeros((0, 1))
    c = x[np.linspace(0, len(x) - 1, max(1, min(most, len(x) // 50))).astype(int)]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


class Blocks(NamedTuple):
    """vectors: vec_id, scope, centroid, closeness, embedding; blocks: scope, centroid, n, widest. Zero vectors have centroid -1."""

    centers: np.ndarray
    vectors: DataFrame
    blocks: DataFrame


def indexed(vectors: DataFrame, scope: str, most: int = CENTROIDS) -> Blocks:
    """Every vector in the block of its nearest centroid."""
    centers = centroids(vectors, most)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            x = _unit(frame["embedding"])
            zero = np.linalg.norm(x, axis=1) < 0.5
            close = x @ centers.T if len(centers) else np.zeros((len(x), 1))
            best = close.argmax(1)
            yield frame.assign(centroid=np.where(zero, -1, best).astype(np.int32), closeness=np.where(zero, 1.0, np.clip(close[np.arange(len(x)), best], -1, 1)))

    kinds = dict(vectors.dtypes)
    placed = vectors.select("vec_id", scope, "embedding").mapInPandas(place, f"vec_id {kinds['vec_id']}, `{scope}` {kinds[scope]}, embedding {kinds['embedding']}, centroid int, closeness double")
    return Blocks(centers, placed, placed.groupBy(scope, "centroid").agg(F.count("*").alias("n"), F.acos(F.min("closeness")).alias("widest")))


def promises(questions: DataFrame, index: Blocks, scope: str) -> DataFrame:
    """query_id, scope, centroid, n, most: the best similarity that each block of a question's scope can have."""

    centers = index.centers

    @F.pandas_udf("array<double>")
    def angles(rows: pd.Series) -> pd.Series:
        x = _unit(rows)
        zero = np.linalg.norm(x, axis=1) < 0.5
        close = np.arccos(np.clip(x @ centers.T, -1, 1)) if len(centers) else np.zeros((len(x), 1))
        close[zero] = -1.0  # a zero question is as near to all
        return pd.Series(list(close))

    asked = questions.select("query_id", scope, angles("embedding").alias("angles")).join(index.blocks, scope)
    angle = F.element_at("angles", F.col("centroid") + 1)
    most = F.when((F.col("centroid") < 0), 0.0).when(angle < 0, 0.0).otherwise(F.cos(F.greatest(angle - F.col("widest"), F.lit(0.0))))
    return asked.select("query_id", scope, "centroid", "n", most.alias("most"))


def _scored(pairs: DataFrame, questions: DataFrame, index: Blocks, scope: str, k: int, split: int, group: int) -> DataFrame:
    """query_id, vec_id, similarity: of each pair of question and block the k best, split by split."""
    spark = pairs.sparkSession
    groups = max(1, math.ceil(questions.count() / group))
    splits = F.ceil(F.col("n") / split).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    by = [scope, "centroid", "_split", "_group"]
    left = pairs.select("query_id", scope, "centroid", "n", every(splits).alias("_split")).join(questions, ["query_id", scope])
    left = left.select(scope, "centroid", "_split", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("_group"), F.lit(0).alias("_kind"), F.col("query_id").alias("_id"), "embedding")
    wanted = pairs.select(scope, "centroid", "n").distinct()
    right = index.vectors.join(wanted, [scope, "centroid"])
    right = right.select(scope, "centroid", F.pmod(F.xxhash64("vec_id"), splits).cast("int").alias("_split"), every(F.lit(groups)).alias("_group"), F.lit(1).alias("_kind"), F.col("vec_id").alias("_id"), "embedding")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = left.unionByName(right).repartition(parts, *by).sortWithinPartitions(*by, "_kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, asked, matrix, held = None, [], [], None, []

        def found() -> Iterator[pd.DataFrame]:
            if held:
                rows = pd.concat(held)
                rows["r"] = rows["similarity"].round(12)
                yield rows.sort_values(["query_id", "r", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k).drop(columns="r")

        for frame in batches:
            for place, part in frame.groupby(by, sort=False, dropna=False):
                if place != at:
                    yield from found()
                    at, ids, asked, matrix, held = place, [], [], None, []
                new = part[part["_kind"] == 0]
                ids += new["_id"].tolist()
                asked += new["embedding"].tolist()
                rows = part[part["_kind"] == 1]
                if not len(rows) or not ids:
                    continue
                matrix = _unit(asked) if matrix is None else matrix
                vec, names = rows["_id"].to_numpy(), np.array(ids)
                held += [pd.DataFrame({"query_id": names[i], "vec_id": vec[j], "similarity": s}) for i, j, s in _best(matrix, _unit(rows["embedding"]), vec, k)]
                if sum(map(len, held)) > 2 * k * len(ids):
                    held = list(found())
        yield from found()

    return dealt.mapInPandas(search, "query_id long, vec_id long, similarity double")


def search_blocks(questions: DataFrame, vectors: DataFrame, k: int, scope: str, most: int = CENTROIDS, split: int = SPLIT, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, similarity of each block's k best that was looked into; the pairs of question and block with n, most and searched)."""
    index = indexed(vectors, scope, most)
    offered = promises(questions, index, scope)
    so_far = F.sum("n").over(topk.Window.partitionBy("query_id").orderBy(F.desc("most"), "centroid").rowsBetween(topk.Window.unboundedPreceding, -1))
    offered = kept(offered.withColumn("first", F.coalesce(so_far, F.lit(0)) < k))
    early = kept(_scored(offered.where("first"), questions, index, scope, k, split, group))
    least = topk.per_group(early, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k, "_r").groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_least"))
    judged = offered.join(least, "query_id", "left")
    again = ~F.col("first") & ((F.coalesce("_n", F.lit(0)) < k) | (F.col("most") >= F.col("_least") - SLACK))
    judged = judged.withColumn("searched", F.col("first") | again).withColumn("_again", again).drop("_n", "_least")
    late = _scored(judged.where("_again").drop("_again"), questions, index, scope, k, split, group)
    return early.unionByName(late), judged.drop("_again")


def search(questions: DataFrame, vectors: DataFrame, k: int = 20, scope: str | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest vectors of each question, exactly. A question may stand in several scopes.

    questions: query_id, embedding (and scope); vectors: vec_id, embedding (and scope). With scope a question sees the
    vectors of its own scope only. Up to block questions without a scope go to every task as one matrix, a task keeps k
    rows a question of each of its batches, and only these are shuffled; all others are searched by blocks. Null vectors
    are left out; a zero vector is as near as a right angle.
    """
    questions, vectors = questions.where("embedding is not null"), vectors.where("embedding is not null")
    order = [F.desc(F.round("similarity", 12)), F.col("vec_id")]
    if scope or questions.count() > block:
        own = scope or "_all"
        q, v = (questions, vectors) if scope else (questions.withColumn(own, F.lit(0)), vectors.withColumn(own, F.lit(0)))
        near, _ = search_blocks(q.select("query_id", own, "embedding"), v.select("vec_id", own, "embedding"), k, own)
        return topk.per_group(near, ["query_id"], order, k)
    rows = questions.select("query_id", "embedding").toPandas()
    if not len(rows):
        return vectors.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    ids, matrix = rows["query_id"].to_numpy(), _unit(rows["embedding"])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            vec = frame["vec_id"].to_numpy()
            for rows, columns, similarity in _best(matrix, _unit(frame["embedding"]), vec, k):
                yield pd.DataFrame({"query_id": ids[rows], "vec_id": vec[columns], "similarity": similarity})

    return topk.per_group(vectors.select("vec_id", "embedding").mapInPandas(nearest, "query_id long, vec_id long, similarity double"), ["query_id"], order, k)


def search_per_document(near: DataFrame, limit: int, documents: int, ceiling: int = 20) -> DataFrame:
    """Of scored rows (query_id, document_id, vec_id, similarity) the best of each document, then ceiling of each question."""
    best = min(max(-(-limit * 3 // documents), 3), 10)
    order = [F.desc("similarity"), F.col("vec_id")]
    return topk.per_group(topk.per_group(near, ["query_id", "document_id"], order, best, "document_rank"), ["query_id"], order, ceiling)
