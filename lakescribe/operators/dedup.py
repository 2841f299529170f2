"""Uploads of a content that a collection has already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A document in one of these states doesn't stand in the way of another of its content.
IGNORED = ("failed", "awaiting_upload")


def duplicate_uploads(docs: DataFrame, content: Column, order: str = "document_id") -> DataFrame:
    """docs with content_sha256 and duplicate_of: the first earlier document of the collection with this content, or null.

    The window shuffles the columns that are asked for: select ids, collections and statuses of the result, and neither
    the text nor anything else goes with the hashes.
    """
    hashed = docs.withColumn("content_sha256", F.sha2(content, 256))
    before = Window.partitionBy("collection_id", "content_sha256").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("duplicate_of", F.min(F.when(~F.col("status").isin(*IGNORED), F.col(order))).over(before))
