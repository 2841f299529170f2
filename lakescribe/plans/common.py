"""Tables of the model made from the given ones, in Spark and as SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import STOP_WORDS
from ..operators import chunking
from ..sources.shared import shared_folder


def workspace(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads again, in the one that the cluster shares."""
    return f"{shared_folder(spark)}/lakescribe-{uuid4().hex}"


SOURCES = 20  # questions are dealt to as many collections


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt anew to all tasks, for work that costs far more than moving its keys: a file of one row group is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")


def chunks(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """document_id, collection_id, filename, chunk_index, content, chunk_id. few: the document_id of those wanted, no more than candidates of questions."""
    own = documents(spark, sf_dir)
    own = own if few is None else own.join(F.broadcast(few), "document_id", "left_semi")
    cut = chunking.chunk_documents(own, ["document_id", "collection_id", "filename"], "text")
    return cut.withColumn("chunk_id", F.shiftleft("document_id", 20) + F.col("chunk_index"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, collection_id, question: items of the benchmark, each asked of one collection."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % SOURCES).cast("string")).alias("collection_id"), F.col("text").alias("question"))


def norm(x: str) -> str:
    """SQL of functions.text.normalize."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def first_distinct(x: str) -> str:
    """SQL: the distinct values of a list in order of their first place."""
    return f"list_transform(list_sort(list_transform(list_distinct({x}), lambda v: {{'p': list_position({x}, v), 'v': v}})), lambda s: s.v)"


def useful(x: str, stop: str = STOP) -> str:
    kept = f"list_filter({x}, lambda t: length(t) > 1 AND t NOT IN ({stop}))"
    return f"({first_distinct(kept)})[1:24]"


#: SQL of chunks().
CHUNKS = r"""
doc AS (
  SELECT doc_id AS document_id, source AS collection_id, source || '-' || doc_id || '.txt' AS filename, text,
    list_filter(string_split_regex(text, '[\s\x{00A0}\x{FEFF}]+'), lambda w: w <> '') AS w FROM documents
), chunks AS (
  SELECT document_id, collection_id, filename, i::INTEGER AS chunk_index, array_to_string(w[i * 346 + 1:i * 346 + 384], ' ') AS content, document_id * 1048576 + i AS chunk_id
  FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 384 THEN 1 ELSE ceil((len(w) - 384) / 346)::INTEGER + 1 END)) AS i FROM doc)
)"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS collection_id, text AS question FROM benchmark)"
