"""How many documents there are, and what they are like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """collection_id, n_documents of every collection, those without documents included."""
    n = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"))
    return collections.select("collection_id").join(n, "collection_id", "left").na.fill(0, ["n_documents"])


def status_counts(documents: DataFrame, statuses: tuple[str, ...], status: str = "status") -> DataFrame:
    """One row: how many documents in all, and with each status."""
    return documents.agg(F.count("*").alias("all"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses])
