"""What is written back: chunks replaced, documents deleted with all that hangs on them, reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with the chunks of incoming's documents replaced: same keys overwritten, later chunks of these documents dropped."""
    return existing.join(incoming.select("document_id").distinct(), "document_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Each table without the rows of the doomed documents."""
    ids = doomed.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; with partition_by only the partitions that df has are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_markdown(df: DataFrame, path: str, key: str, text: str = "markdown") -> None:
    """A folder of text files for each key: a report is one row, written whole."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)
