"""What a question may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with user_id, filename, processing_mode of their documents, ready ones only; joined on document and collection."""
    ready = documents.where("status = 'ready'").select("document_id", "collection_id", "user_id", "filename", "processing_mode")
    return chunks.drop("filename", "user_id", "processing_mode").join(ready, ["document_id", "collection_id"])


def searchable(chunks: DataFrame, documents: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id and the chunks in each question's scope: its collection, its user's, ready, with a vector; of document_ids only, if it names some."""
    own = join_documents(chunks.where("embedding is not null"), documents)
    q = questions.select("query_id", "collection_id", "user_id", *([c] if (c := "document_ids") in questions.columns else []))
    seen = own.join(q, ["collection_id", "user_id"])
    if "document_ids" not in questions.columns:
        return seen
    return seen.where(F.coalesce(F.size("document_ids") <= 0, F.lit(True)) | F.array_contains("document_ids", F.col("document_id"))).drop("document_ids")


def attach_projection(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates with the masked text of their chunks; all of them, not only the first."""
    return candidates.join(chunks.select("chunk_id", "provider_safe_content"), "chunk_id", "left")
