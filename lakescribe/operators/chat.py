"""Conversations: questions with their answers, the last messages, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_MESSAGES = 1000


def pair_messages(messages: DataFrame, keys: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """keys, question_at, answer_at, question, answer: each assistant message whose last message before, of user or assistant, is a user's."""
    said = messages.where(F.col(role).isin("user", "assistant"))
    before = Window.partitionBy(*keys).orderBy(order)
    prior = F.lag(F.struct(F.col(role).alias("role"), F.col(order).alias("at"), F.col(text).alias("text"))).over(before)
    pairs = said.withColumn("_p", prior).where((F.col(role) == "assistant") & (F.col("_p.role") == "user"))
    return pairs.select(*keys, F.col("_p.at").alias("question_at"), F.col(order).alias("answer_at"), F.col("_p.text").alias("question"), F.col(text).alias("answer"))


def recent(messages: DataFrame, keys: list[str], order: str, limit: int = MOST_MESSAGES) -> DataFrame:
    """The last limit messages of each conversation with truncated: whether there are more."""
    own = Window.partitionBy(*keys)
    ranked = messages.withColumn("_k", F.row_number().over(own.orderBy(F.desc(order)))).withColumn("truncated", F.count("*").over(own) > limit)
    return ranked.where(F.col("_k") <= limit).drop("_k")


def transcript(pairs: DataFrame, keys: list[str], order: str = "answer_at", title: str = "Conversation", question: str = "question", answer: str = "answer") -> DataFrame:
    """keys, markdown: the questions and answers of a conversation in order. Masked columns give a masked transcript."""
    turns = F.sort_array(F.collect_list(F.struct(order, F.col(question).alias("q"), F.col(answer).alias("a"))))
    part = lambda x, k: F.concat(F.lit("## Question "), (k + 1).cast("string"), F.lit("\n\n"), x["q"], F.lit("\n\n### Answer\n\n"), x["a"])
    return pairs.groupBy(*keys).agg(turns.alias("_t")).select(*keys, F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("_t", part), "\n\n")).alias("markdown"))
