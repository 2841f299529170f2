"""Readers: snapshots, stored objects, documents, golden question sets, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import kind

SNAPSHOT = {
    "objects": "path string, size bigint, created_at timestamp, updated_at timestamp, owner_id string",
    "documents": "document_id string, collection_id string, user_id string, filename string, storage_path string, file_size bigint, status string, processing_stage string, processing_started_at timestamp, created_at timestamp",
    "collections": "collection_id string, user_id string, name string",
    "chunks": "chunk_id string, document_id string, collection_id string, chunk_index int",
    "null_embeddings": "chunk_id string",
}
GOLDEN = "documents array<struct<id:string,filename:string,format:string,processingMode:string,passages:array<struct<id:string,text:string>>>>, cases array<struct<id:string,split:string,category:string,question:string,answerable:boolean,refusalReason:string,requiredDocumentIds:array<string>,support:array<struct<documentId:string,passageId:string,grade:int>>>>"


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of a workspace, by their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SNAPSHOT.items()}


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """path, size, updated_at of every file below root; contents aren't read, as the column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, filename, kind, content, text of every file below root of a kind that is text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    known = files.select("path", name.alias("filename"), kind(name).alias("kind"), "content").where(F.col("kind").isin("text", "markdown", "html", "csv"))
    return known.withColumn("text", F.decode("content", "UTF-8"))


def read_golden(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """documents, passages, cases, support of a nested golden set: a file of JSON, or without multi_line a part of it in each line."""
    raw = spark.read.schema(GOLDEN).option("multiLine", multi_line).json(path)
    docs = raw.select(F.explode("documents").alias("d"))
    cases = raw.select(F.explode("cases").alias("c"))
    return {
        "documents": docs.select(F.col("d.id").alias("document_id"), "d.filename", "d.format", F.coalesce("d.processingMode", F.lit("standard")).alias("processing_mode")),
        "passages": docs.select(F.col("d.id").alias("document_id"), F.explode("d.passages").alias("p")).select("document_id", F.col("p.id").alias("passage_id"), "p.text"),
        "cases": cases.select(F.col("c.id").alias("case_id"), "c.split", "c.category", "c.question", "c.answerable", F.col("c.refusalReason").alias("refusal_reason"), F.col("c.requiredDocumentIds").alias("required")),
        "support": cases.select(F.col("c.id").alias("case_id"), F.explode("c.support").alias("s")).select("case_id", F.col("s.documentId").alias("document_id"), F.col("s.passageId").alias("passage_id"), "s.grade"),
    }


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
