"""Checks of data: constraints, pages with little text, vectors, rows that another owner must not see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words
from . import numbering

MOST_PAGES, MOST_CHARACTERS, MOST_UNITS = 500, 1_500_000, 20_000
#: Least characters and words of readable content by kind.
LEAST_CONTENT = {"text": (10, 2), "html": (10, 2), "markdown": (10, 1), "csv": (10, 1), "docx": (20, 5), "pdf": (20, 5), "xlsx": (3, 1)}


def check_rows(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """table, rule, violations: how many rows break each rule; a rule that is null for a row is not broken. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counts.select(F.lit(table).alias("table"), F.explode(pairs).alias("x")).select("table", "x.*")


def check_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """table, rule, violations: rows beyond the first of each key."""
    n = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return n.select(F.lit(table).alias("table"), F.lit(f"unique({', '.join(keys)})").alias("rule"), "violations")


def check_reference(df: DataFrame, table: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """table, rule, violations: rows whose parent doesn't exist."""
    gone = df.select(F.col(key).alias("_k")).where("_k is not null").join(parents.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return gone.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit(f"{key} -> {parent_key}").alias("rule"), "violations")


def projection_rule() -> Column:
    """A chunk's masked text exists exactly if its document is private; so do its policy version and kind of projection."""
    private = F.col("processing_mode") == "privacy_minimised"
    masked = F.col("provider_safe_content").isNotNull() & F.col("privacy_policy_version").isNotNull()
    return F.when(private, masked & (F.col("embedding_projection") == "privacy_minimised")).otherwise(F.col("provider_safe_content").isNull() & (F.col("embedding_projection") == "original"))


def check_constraints(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """table, rule, violations for the rules of the model's two large tables."""
    doc_rules = {
        "status known": F.col("status").isin("awaiting_upload", "processing", "ready", "failed"),
        "mode known": F.col("processing_mode").isin("standard", "privacy_minimised"),
        "file name not blank": F.trim("filename") != "",
        "file size": F.col("file_size") >= 0,
    }
    chunk_rules = {"page number": F.col("page_number") >= 1, "chunk index": F.col("chunk_index") >= 0, "content not blank": F.trim("content") != ""}
    modes = chunks.drop("processing_mode").join(documents.select("document_id", "processing_mode"), "document_id")
    parts = [
        check_rows(documents, "documents", doc_rules),
        check_unique(documents, "documents", ["storage_path"]),
        check_rows(chunks, "document_chunks", chunk_rules),
        check_unique(chunks, "document_chunks", ["document_id", "chunk_index"]),
        check_reference(chunks, "document_chunks", "document_id", documents, "document_id"),
        check_rows(modes, "document_chunks", {"privacy projection": projection_rule()}),
    ]
    return reduce(DataFrame.unionByName, parts)


def mode_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, old_mode, new_mode of documents whose mode isn't what it was."""
    a, b = old.select("document_id", F.col("processing_mode").alias("old_mode")), new.select("document_id", F.col("processing_mode").alias("new_mode"))
    return a.join(b, "document_id").where(~F.col("old_mode").eqNullSafe(F.col("new_mode")))


def extraction_limits(docs: DataFrame, pages: int = MOST_PAGES, characters: int = MOST_CHARACTERS, units: int = MOST_UNITS) -> DataFrame:
    """docs (page_count, char_count, n_units) with violation, null where none."""
    over = F.when(F.col("page_count") > pages, "too_many_pages").when(F.col("char_count") > characters, "too_many_characters").when(F.col("n_units") > units, "too_many_units")
    return docs.withColumn("violation", over)


def sparse_pages(pages: DataFrame, text: str = "text", characters: int = 80, words: int = 12) -> DataFrame:
    """Pages with some text, but fewer characters or words than a page of text has."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return pages.where((F.length(flat) > 0) & ((F.length(flat) < characters) | (count_words(F.col(text)) < words)))


def low_text_documents(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_pages, characters, words of documents with hardly any text, in all or by the page."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    one = pages.select(*keys, F.length(flat).alias("_c"), count_words(F.col(text)).alias("_w"))
    sums = one.groupBy(*keys).agg(F.count("*").alias("n_pages"), F.sum("_c").alias("characters"), F.sum("_w").alias("words"))
    return sums.where("characters < 80 or words < 20 or (n_pages > 3 and characters / n_pages < 100)")


def min_content(docs: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """docs with too_short: less readable content than the kind asks for."""
    least = F.create_map(*[x for k, (c, w) in LEAST_CONTENT.items() for x in (F.lit(k), F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")))])[F.col(kind)]
    return docs.withColumn("too_short", F.coalesce((F.length(F.trim(text)) < least["c"]) | (count_words(F.col(text)) < least["w"]), F.lit(False)))


def check_vectors(chunks: DataFrame, width: int, keys: list[str], vector: str = "embedding") -> DataFrame:
    """keys, n, n_missing, n_bad, whole: null vectors, those of another width or with nulls or NaN; whole: all are there, or none."""
    bad = F.col(vector).isNotNull() & ((F.size(vector) != width) | F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    sums = chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(vector).isNull()).alias("n_missing"), F.count_if(bad).alias("n_bad"))
    return sums.withColumn("whole", (F.col("n_missing") == 0) | (F.col("n_missing") == F.col("n")))


def tenant_leaks(results: DataFrame, documents: DataFrame) -> DataFrame:
    """results (query_id, user_id, document_id) of documents that another user owns; must be empty."""
    owners = documents.select("document_id", F.col("user_id").alias("owner_id"))
    return results.join(owners, "document_id").where(~F.col("user_id").eqNullSafe(F.col("owner_id")))


def user_status(docs: DataFrame, status: str | None = None, in_task: int = numbering.IN_TASK) -> DataFrame:
    """docs with shown_status, and place in their collection, newest first: uploads that are awaited show as processing.

    status: only these. Collections of more than in_task documents are numbered by ranges.
    """
    out = docs.withColumn("shown_status", F.when(F.col("status") == "awaiting_upload", "processing").otherwise(F.col("status")))
    out = out.where(F.col("shown_status") == status) if status else out
    return numbering.row_numbers(out, ["collection_id"], [F.desc("created_at"), F.col("document_id")], "place", None, in_task).withColumn("place", F.col("place").cast("int"))
