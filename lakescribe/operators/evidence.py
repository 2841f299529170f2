"""Whether what was retrieved is enough to answer a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import ROLES, role_concepts
from ..functions.text import normalize, tokens
from .coverage import MEANINGFUL, SIMILAR, is_qualifying

MOST_SOURCES, MOST_CHARACTERS, MOST_TERMS, LEAST_TERM = 10, 3000, 12, 4
# Words that say nothing of what is asked.
STOP_WORDS = "a about an and are as at be by can did do for from how i in is it me of on or please tell that the these this to was were what when where which who why with".split()
NO_ANSWER = "The uploaded documents do not contain enough evidence to answer this question."
ROLE = "role:"


def terms(question: Column) -> Column:
    """Distinct words of four letters or more; a role that is named stands for its words."""
    roles = role_concepts(question)
    parts = [w for full in ROLES.values() for w in full.split()]
    words = F.array_distinct(F.filter(tokens(question), lambda t: (F.length(t) >= LEAST_TERM) & ~t.isin(STOP_WORDS)))
    plain = F.when(F.size(roles) > 0, F.filter(words, lambda t: ~t.isin(parts))).otherwise(words)
    return F.slice(F.concat(plain, F.transform(roles, lambda r: F.concat(F.lit(ROLE), r))), 1, MOST_TERMS)


def assess(questions: DataFrame, sources: DataFrame, required: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """query_id, n_meaningful, n_matched, n_needed, status (strong, weak, none), sufficient, reason.

    questions: query_id, question, retrieval_reason; sources: query_id, content, retrieval_mode, relevance_score, document_id,
    keyword_score, semantic_similarity; required: query_id, document_id; citations: query_id, rejected, cited_documents.
    Only rows of mode semantic lend a similarity. Words match words that begin with them or that they begin with.
    """
    q = questions.select("query_id", "question", "retrieval_reason").withColumn("_terms", terms(F.col("question")))
    s = sources.select("query_id", "content", "retrieval_mode", "relevance_score", "document_id", "keyword_score", "semantic_similarity").withColumn("_words", F.array_distinct(tokens(F.col("content")))).withColumn("_ok", F.length(normalize(F.col("content"))) >= MEANINGFUL)
    role = lambda t, text: F.contains(text, F.replace(F.substring(t, len(ROLE) + 1, 200), F.lit("_"), F.lit(" ")))
    word = lambda t, words: F.array_contains(words, t) | F.exists(words, lambda w: (F.length(w) >= 5) & (w.startswith(t) | t.startswith(w)))
    pairs = q.select("query_id", "_terms").join(s.withColumn("_text", normalize(F.col("content"))), "query_id")
    hit = F.filter("_terms", lambda t: F.when(t.startswith(ROLE), role(t, F.col("_text"))).otherwise(word(t, F.col("_words"))))
    good = is_qualifying(F.col("content"), F.col("keyword_score").cast("double"), F.coalesce(F.col("semantic_similarity"), F.when(F.col("retrieval_mode") == "semantic", F.col("relevance_score"))).cast("double"))
    found = pairs.select("query_id", "_ok", F.when(F.col("_ok"), hit).otherwise(F.array().cast("array<string>")).alias("_hit"), (F.length("content") > MOST_CHARACTERS).alias("_long"), F.when(F.col("retrieval_mode") == "semantic", F.col("relevance_score")).alias("_sim"), F.when(good, F.col("document_id")).alias("_doc"))
    sums = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.count_if("_ok").alias("n_meaningful"), F.size(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("n_matched"), F.bool_or("_long").alias("_long"), F.max("_sim").alias("_sim"), F.collect_set("_doc").alias("_docs"))
    out = q.join(sums, "query_id", "left").na.fill(0, ["_n", "n_meaningful", "n_matched"])
    none = F.array().cast(dict(sources.dtypes)["document_id"].join(["array<", ">"]))
    need = required.groupBy("query_id").agg(F.collect_set("document_id").alias("_req")) if required is not None else None
    out = out.join(need, "query_id", "left") if need is not None else out.withColumn("_req", none)
    out = out.join(citations.select("query_id", "rejected", "cited_documents"), "query_id", "left") if citations is not None else out.withColumn("rejected", F.lit(False)).withColumn("cited_documents", F.lit(None).cast(none_type(sources)))
    several = F.size(F.coalesce("_req", none)) > 1
    n_needed = F.when(F.size("_terms") >= 4, 2).when(F.size("_terms") > 0, 1).otherwise(0)
    lexical, similar = (F.col("n_needed") > 0) & (F.col("n_matched") >= F.col("n_needed")), F.coalesce(F.col("_sim") >= SIMILAR, F.lit(False))
    reason = (
        F.when(~F.col("_n").between(1, MOST_SOURCES) | F.coalesce("_long", F.lit(False)), "out_of_bounds")
        .when(F.col("n_meaningful") == 0, "no_meaningful_source")
        .when(F.col("retrieval_reason").isin("no_chunks_found", "broad_context_fallback"), "broad_or_empty_retrieval")
        .when(~lexical & ~similar, "too_little_support")
        .when(F.coalesce("rejected", F.lit(False)), "citations_invalid")
        .when(several & (F.size(F.array_except(F.coalesce("_req", none), F.coalesce("_docs", none))) > 0), "required_source_missing")
        .when(several & F.col("cited_documents").isNotNull() & (F.size(F.array_except(F.coalesce("_req", none), F.coalesce("cited_documents", none))) > 0), "required_citation_missing")
        .otherwise("sufficient")
    )
    out = out.withColumn("n_needed", n_needed).withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "sufficient")
    status = F.when(F.col("sufficient"), "strong").when(F.col("n_meaningful") > 0, "weak").otherwise("none")
    return out.select("query_id", "n_meaningful", "n_matched", "n_needed", status.alias("status"), "sufficient", "reason")


def none_type(sources: DataFrame) -> str:
    return f"array<{dict(sources.dtypes)['document_id']}>"


def guard(answers: DataFrame, insufficient: str = "insufficient", text: str = NO_ANSWER) -> DataFrame:
    """answers (answer, citations) where those without enough evidence say so and cite nothing."""
    bad = F.coalesce(F.col(insufficient), F.lit(False))
    return answers.withColumn("answer", F.when(bad, text).otherwise(F.col("answer"))).withColumn("citations", F.when(bad, F.slice("citations", 1, 0)).otherwise(F.col("citations")))
