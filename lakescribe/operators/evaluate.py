"""How good retrieval is: support of passages, graded relevance, ranking metrics, refusals, gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens
from ..sources.shared import kept

SUPPORT, LEAST_TERM, K = 0.7, 4, 5
#: Words of passages that may be sent to every task, in all.
SENT = 1_000_000
GATES = {"hit": 1.0, "mrr": 0.95, "ndcg": 0.95, "precision": 0.45, "recall": 0.9}


def long_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= LEAST_TERM))


def passage_support(chunks: DataFrame, passages: DataFrame, share: float = SUPPORT) -> DataFrame:
    """chunk_id, passage_id, overlap of pairs where a chunk has at least share of a passage's distinct long words.

    chunks: chunk_id, content; passages: passage_id, text. Where the passages have SENT words or fewer in all, which is counted
    first, these go to every task and a chunk is held against all passages where it is read, without a shuffle; more meet the
    chunks by their rarest words.
    """
    own = passages.select("passage_id", long_tokens(F.col("text")).alias("_p")).where(F.size("_p") > 0)
    few = (own.agg(F.sum(F.size("_p"))).first()[0] or 0) <= SENT
    return _held(chunks, own, share) if few else _met(chunks, own, share)


def _held(chunks: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """passage_support by an index of the passages in each task: its words' lists of passages, counted for each chunk."""
    rows = own.collect()
    ids, sizes = [r["passage_id"] for r in rows], np.array([len(r["_p"]) for r in rows])
    lists: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        for word in r["_p"]:
            lists.setdefault(word, []).append(k)
    having = {word: np.array(places, np.int32) for word, places in lists.items()}

    def overlaps(text: str) -> list[tuple]:
        met = [having[w] for w in set(text.split(" ")) if w in having]
        if not met:
            return []
        overlap = np.bincount(np.concatenate(met), minlength=len(ids)) / sizes
        return [(ids[k], float(overlap[k])) for k in np.flatnonzero(overlap >= share)]

    @F.pandas_udf(f"array<struct<passage_id:{dict(own.dtypes)['passage_id']},overlap:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([overlaps(x) for x in texts], dtype=object)

    texts = chunks.where(F.col("content").isNotNull()).select("chunk_id", normalize(F.col("content")).alias("_text"))
    return texts.select("chunk_id", F.inline(run("_text")))


def _met(chunks: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """passage_support by joins: a chunk with so many of n words has one of the passage's n - ceil(share n) + 1 rarest, so only
    chunks with one of these are looked at; no pair is lost and frequent words join nothing."""
    has = kept(chunks.select("chunk_id", long_tokens(F.col("content")).alias("_c")).where(F.size("_c") > 0))
    frequency = has.select(F.explode("_c").alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    wants = own.select("passage_id", F.explode("_p").alias("term")).join(frequency, "term", "left").na.fill(0, ["_df"])
    by = Window.partitionBy("passage_id")
    wants = wants.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy("_df", "term")))
    rare = wants.where(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * F.lit(share)) + 1)
    met = rare.select("passage_id", "term").join(has.select("chunk_id", F.explode("_c").alias("term")), "term")
    near = met.select("chunk_id", "passage_id").distinct().join(has, "chunk_id").join(own, "passage_id")
    scored = near.select("chunk_id", "passage_id", (F.size(F.array_intersect("_c", "_p")) / F.size("_p")).alias("overlap"))
    return scored.where(F.col("overlap") >= share)


def grades(results: DataFrame, support: DataFrame) -> DataFrame:
    """results (query_id, chunk_id, rank) with grade: the highest of a passage that the chunk supports, else 0. support: query_id, chunk_id, grade."""
    best = support.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    return results.join(best, ["query_id", "chunk_id"], "left").na.fill(0, ["grade"])


def metrics(graded: DataFrame, relevant: DataFrame, k: int = K) -> DataFrame:
    """query_id, hit, mrr, recall, precision, ndcg at k of each query with something relevant.

    graded: query_id, rank, grade (and chunk_id); relevant: query_id, chunk_id, grade of all that is relevant.
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    ideal = relevant.where("grade > 0").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("_all"), F.sum(F.when(F.col("_r") <= k, gain(F.col("grade"), F.col("_r"))).otherwise(0.0)).alias("_ideal"))
    top = graded.where(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("_found"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("_first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("_gain"))
    both = ideal.join(top, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        F.coalesce((F.col("_found") > 0).cast("double"), F.lit(0.0)).alias("hit"),
        zero(1.0 / F.col("_first")).alias("mrr"),
        zero(F.col("_found") / F.col("_all")).alias("recall"),
        zero(F.col("_found") / F.lit(float(k))).alias("precision"),
        zero(F.col("_gain") / F.col("_ideal")).alias("ndcg"),
    )


def mean(per_query: DataFrame, names: tuple[str, ...] = ("hit", "mrr", "recall", "precision", "ndcg")) -> DataFrame:
    """One row: the mean of each metric."""
    return per_query.agg(*[F.avg(n).alias(n) for n in names])


def gates(means: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """metric, value, threshold, passed."""
    rows = [means.select(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(t).alias("threshold")) for n, t in (thresholds or GATES).items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def refusals(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, missing_terms, refuse, right: a question is refused if any of its long words is nowhere in the chunks. cases: query_id, question, answerable."""
    known = chunks.select(F.explode(long_tokens(F.col("content"))).alias("term")).distinct().withColumn("_k", F.lit(1))
    asked = cases.select("query_id", F.explode_outer(long_tokens(F.col("question"))).alias("term")).join(known, "term", "left")
    gone = asked.groupBy("query_id").agg(F.sort_array(F.collect_set(F.when(F.col("_k").isNull(), F.col("term")))).alias("missing_terms"))
    out = cases.select("query_id", "answerable").join(gone, "query_id").withColumn("refuse", F.size("missing_terms") > 0)
    return out.select("query_id", "missing_terms", "refuse", (F.col("refuse") != F.col("answerable")).alias("right"))


def compare_fusion(runs: dict[str, DataFrame], relevant: DataFrame, k: int = 3) -> DataFrame:
    """mode, hit: the share of queries with something relevant among the first k, for each way of fusing. runs: mode -> graded rows."""
    rows = [metrics(graded, relevant, k).agg(F.avg("hit").alias("hit")).select(F.lit(mode).alias("mode"), "hit") for mode, graded in runs.items()]
    return reduce(DataFrame.unionByName, rows)
