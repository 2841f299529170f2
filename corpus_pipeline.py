"""From documents to packed sequences: language, quality, near-duplicates, packing.

Each stage works on all rows that the one before it kept, and is written and read again before the next, in a new folder of
the one that the cluster shares; the folder of a run stays until whoever owns the shared one clears it, as the result reads it.

In all stages rows with a null id, repeated rows and other columns than those of documents do no harm: a row is judged by
its own text, other columns are dropped, and an empty table gives an empty one. What a null or empty text means, each says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescribe.llm import language_id, packing, pu_quality, simhash
from lakescribe.llm.common import shared_folder, table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest centroid is near enough; the model is learned from docs itself.

    Null texts and texts without a letter have no language and go. Where no row with a letter names its language, nothing
    can be learned and all rows stay. Rows with a null id are judged like others, but nothing is learned from them.
    """
    model = language_id.fit(language_id.learnable(docs))
    known = docs if model is None else docs.where(~language_id.prediction(model, F.col("text"))["rejected"])
    return known.select(*COLUMNS)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier's score predicts to be good; it is learned from docs and the labels.

    Null texts count as empty and are scored like others. Without a label of 1 among docs nothing can be learned and all
    rows stay. Labels of null ids and null labels teach nothing.
    """
    model = pu_quality.fit(*pu_quality.learnable(docs, table(spark, sf_dir, "labels")))
    good = docs if model is None else docs.where(pu_quality.score(model, F.col("text")) >= pu_quality.THRESHOLD)
    return good.select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates.

    Null and empty texts are one class, as they have one fingerprint. Of rows that repeat the least id one stays; a class
    of null ids alone keeps one of them.
    """
    return simhash.keep_first(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of what is left.

    A null or empty text is one piece, the end id alone; rows that repeat an id are packed as rows of their own.
    """
    from public_tokenizers import path

    return packing.pack_documents(docs, path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_language),
    ("quality_classifier", keep_good_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifiers nor the hash; the stages are tested against versions by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
