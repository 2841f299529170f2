"""One ranking from a keyword lane and a semantic lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.query import expand_roles, identifiers, useful
from ..functions.text import normalize, tokens

K, BOOST, SEMANTIC, LEXICAL, RERANK = 60, 0.001, 0.55, 0.35, 0.10
# Words that earn no boost.
STOP_WORDS = "a an and both document explain file for from how is of the to using with".split()


def merge(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, chunk_id, keyword_score, semantic_similarity: the best score of each lane; one shuffle for both."""
    both = keyword.select("query_id", "chunk_id", F.col("keyword_score").cast("double").alias("keyword_score"), F.lit(None).cast("double").alias("semantic_similarity")).unionByName(
        semantic.select("query_id", "chunk_id", F.lit(None).cast("double").alias("keyword_score"), F.col("semantic_similarity").cast("double").alias("semantic_similarity"))
    )
    return both.groupBy("query_id", "chunk_id").agg(F.max("keyword_score").alias("keyword_score"), F.max("semantic_similarity").alias("semantic_similarity"))


def identifier_phrases(question: Column) -> Column:
    return F.filter(F.transform(identifiers(question), normalize), lambda p: p != "")


def with_boost(df: DataFrame, question: str = "question", filename: str = "filename", content: str = "content") -> DataFrame:
    """df with boost and bears_identifier. boost: 1 if the chunk has an identifier of the question; else 0.7 for the file's name in it and 0.15 for a long term of it.

    Normalised texts are columns of a projection of their own: within the lambdas they would be computed for each term.
    """
    asked = expand_roles(F.col(question))
    said, name, text, ids, long = fresh(df, "said", "name", "text", "ids", "long")
    out = df.select(
        "*",
        normalize(asked).alias(said),
        normalize(F.col(filename)).alias(name),
        normalize(F.col(content)).alias(text),
        identifier_phrases(F.col(question)).alias(ids),
        useful(tokens(asked), STOP_WORDS).alias(long),
    )
    named = F.when((F.length(name) > 2) & F.contains(F.col(said), F.col(name)), 0.7).otherwise(0.0)
    rare = F.when(F.exists(long, lambda t: (F.length(t) >= 6) & F.contains(F.col(text), t)), 0.15).otherwise(0.0)
    out = out.withColumn("bears_identifier", F.exists(ids, lambda p: F.contains(F.col(text), p)))
    return out.withColumn("boost", F.when(F.col("bears_identifier"), 1.0).otherwise(F.least(F.lit(1.0), named + rare))).drop(said, name, text, ids, long)


def _mode() -> Column:
    return F.when(F.col("keyword_score").isNotNull() & F.col("semantic_similarity").isNotNull(), "hybrid").when(F.col("keyword_score").isNotNull(), "keyword").otherwise("semantic")


def rrf(merged: DataFrame, limit: int, k: int = K, boost_col: str = "boost") -> DataFrame:
    """merged (with filename, chunk_index and a boost) with fusion_score, retrieval_mode and rank, the first limit of each question.

    The score sums 1 / (k + rank) over the lanes that have the chunk, and BOOST times its boost.
    """
    by = Window.partitionBy("query_id")
    lane = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(by.orderBy(F.desc_nulls_last(c), "filename", "chunk_index", "chunk_id")))
    ranked = merged.withColumn("keyword_rank", lane("keyword_score")).withColumn("semantic_rank", lane("semantic_similarity"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = ranked.withColumn("fusion_score", part("keyword_rank") + part("semantic_rank") + BOOST * F.col(boost_col)).withColumn("retrieval_mode", _mode())
    order = by.orderBy(F.desc(F.round("fusion_score", 12)), "filename", "chunk_index", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rescue_identifier(ranked: DataFrame, limit: int, bears: str = "bears_identifier") -> DataFrame:
    """The first limit of each question; if none of them bears an identifier, the best that does takes the last place."""
    by = Window.partitionBy("query_id")
    top = F.max(((F.col("rank") <= limit) & F.col(bears)).cast("int")).over(by)
    first = F.min(F.when(F.col(bears), F.col("rank"))).over(by)
    t, b = fresh(ranked, "in_top", "best")
    marked = ranked.withColumn(t, top).withColumn(b, first)
    rescued = (F.col(t) == 0) & (F.col("rank") == F.col(b))
    kept = F.when((F.col(t) == 0) & F.col(b).isNotNull(), F.col("rank") <= limit - 1).otherwise(F.col("rank") <= limit)
    return marked.where(kept | rescued).withColumn("rank", F.when(rescued, limit).otherwise(F.col("rank"))).drop(t, b)


def weighted(merged: DataFrame, limit: int, boost_col: str = "boost") -> DataFrame:
    """merged with fusion_score by scores stretched to 0 to 1 in each lane; a lane without the chunk gives 0, one with equal scores 1."""
    by = Window.partitionBy("query_id")

    def stretched(c: str) -> Column:
        low, high = F.min(c).over(by), F.max(c).over(by)
        return F.when(F.col(c).isNull(), 0.0).when(low == high, 1.0).otherwise((F.col(c) - low) / (high - low))

    scored = merged.withColumn("fusion_score", stretched("semantic_similarity") * SEMANTIC + stretched("keyword_score") * LEXICAL + F.col(boost_col) * RERANK).withColumn("retrieval_mode", _mode())
    order = by.orderBy(F.desc(F.round("fusion_score", 12)), "filename", "chunk_index", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
