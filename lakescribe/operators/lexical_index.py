"""Postings that are stored: written once by term, read by any number of questions, brought up to date by documents.

An index is a folder of segments. A segment holds the postings of some documents in buckets by a hash of the term, sorted by
term, so that a batch of questions reads the buckets of its terms and in them the row groups of these, without a
shuffle. Documents that change come as a new segment, which says which documents it replaces: of these, older segments'
rows don't count. A log names the segments that make the index; compact() writes them anew as one.

A stored row is a term of some chunks that were read together: their keys and positions are arrays. Each task writes its own
rows to the buckets, so writing needs no shuffle either; a bucket has a file of each task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.text import normalize
from .lexical import WEIGHTS

BUCKETS = 256
#: Chunks whose words are sorted together.
TOGETHER = 2_000
#: What a stored row has once; other columns are arrays.
ONCE = ("term", "field", "weight")
LOG = "version long, segments array<long>, buckets int, schema string"


def _log(spark: SparkSession, path: str) -> tuple[int, list[int], int, str]:
    """version, segments, buckets, the postings' schema of the newest entry; version 0 where there is no index yet."""
    try:
        newest = spark.read.schema(LOG).parquet(f"{path}/log").orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return (0, [], BUCKETS, "") if newest is None else tuple(newest)


def _entry(spark: SparkSession, path: str, version: int, segments: list[int], buckets: int, schema: str) -> None:
    spark.createDataFrame([(version, segments, buckets, schema)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _write(packed: DataFrame, folder: str, buckets: int) -> None:
    placed = packed.withColumn("bucket", _bucket(buckets))
    placed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _schema(kinds: dict[str, str], keys: list[str]) -> str:
    return "term string, field string, weight double, " + ", ".join(f"`{k}` array<{kinds[k]}>" for k in keys) + ", pos array<array<int>>"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts, and the end of the last."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(new)).astype(np.int32)


def _packed(postings: DataFrame) -> DataFrame:
    """Stored rows of postings whose pos is an array: those that stand together and have term, field and weight in common."""
    kinds = dict(postings.dtypes)
    keys = [c for c in postings.columns if c not in (*ONCE, "pos")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.select(list(ONCE)).to_pandas().groupby(list(ONCE), sort=False, dropna=False).ngroup().to_numpy()
            order = code.argsort(kind="stable")
            ends = _starts(code[order])
            rows = batch.take(pa.array(order))
            heads = [rows.column(c).take(pa.array(ends[:-1])) for c in ONCE]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.ListArray.from_arrays(pa.array(ends), rows.column(c)) for c in (*keys, "pos")]], names=[*ONCE, *keys, "pos"])

    return postings.select(*ONCE, *keys, "pos").mapInArrow(pack, _schema(kinds, keys))


def _packed_chunks(chunks: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Stored rows of all words of chunks, without a row for each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                for field in fields:
                    texts = pc.split_pattern(pc.fill_null(batch.column(f"_{field}"), ""), " ")
                    sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
                    words = texts.flatten().dictionary_encode()
                    code, chunk = words.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                    pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    order = code.argsort(kind="stable")
                    order = order[pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[code[order]]]  # a text without words is an empty one
                    if not len(order):
                        continue
                    code, chunk, pos = code[order], chunk[order], pos[order]
                    ends = _starts(code, chunk)  # of a term in a chunk
                    rows = _starts(code[ends[:-1]])
                    terms = words.dictionary.take(pa.array(code[ends[rows[:-1]]]))
                    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos, pa.int32()))
                    own = [batch.column(k).take(pa.array(chunk[ends[:-1]])) for k in keys]
                    once = [terms, pa.array([field] * len(terms)), pa.array([WEIGHTS[field]] * len(terms))]
                    yield pa.RecordBatch.from_arrays([*once, *[pa.ListArray.from_arrays(pa.array(rows), x) for x in (*own, places)]], names=[*ONCE, *keys, "pos"])

    texts = chunks.select(*keys, *[normalize(F.col(column)).alias(f"_{field}") for field, column in fields.items()])
    return texts.mapInArrow(pack, _schema(dict(chunks.dtypes), keys))


def add(postings: DataFrame, documents: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Puts the postings of documents (document_id) in the index in the place of those they had; returns the segment's number.

    A document without postings loses those it had. The first call makes the index and says how many buckets it has. One
    writer at a time; a call that dies leaves the index as it was.
    """
    return _add(_packed(postings.withColumn("pos", F.array("pos"))), documents, path, buckets)


def add_chunks(chunks: DataFrame, keys: list[str], fields: dict[str, str], documents: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """As add() of lexical.build_postings(chunks, keys, fields), but words are sorted where they are read and never become rows."""
    return _add(_packed_chunks(chunks, keys, fields), documents, path, buckets)


def _add(packed: DataFrame, documents: DataFrame, path: str, buckets: int) -> int:
    spark = packed.sparkSession
    version, segments, own, schema = _log(spark, path)
    own, schema = (own, schema) if segments else (buckets, packed.schema.json())
    segment = version + 1
    _write(packed, f"{path}/segment={segment}", own)
    documents.select("document_id").distinct().write.mode("overwrite").parquet(f"{path}/replaced={segment}")
    _entry(spark, path, version + 1, [*segments, segment], own, schema)
    return segment


def read(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """The index's postings; with terms only theirs, of which only the buckets are read. No shuffle, but for documents that
    have been replaced, if these are too many to be sent to every task."""
    rows = _listed(spark, path, terms)
    return rows.withColumn("pos", F.explode("pos"))


def _listed(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """read() with a chunk's positions of a term in an array."""
    _, segments, buckets, kind = _log(spark, path)
    if not segments:
        raise ValueError(f"no index at {path}")
    schema = StructType.fromJson(json.loads(kind)).add("bucket", IntegerType())
    wanted = None if terms is None else sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(buckets)).distinct().collect()})
    out = None
    for k, segment in enumerate(segments):
        rows = spark.read.schema(schema).parquet(f"{path}/segment={segment}")
        if wanted is not None:
            rows = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
        keys = [f.name for f in schema if f.name not in (*ONCE, "pos", "bucket")]
        rows = rows.select(*ONCE, F.inline(F.arrays_zip(*keys, "pos"))).select(*keys, "field", "pos", "term", "weight")
        later = segments[k + 1 :]
        if later:
            gone = spark.read.parquet(*[f"{path}/replaced={s}" for s in later]).select("document_id").distinct()
            rows = rows.join(gone, "document_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def compact(spark: SparkSession, path: str) -> int:
    """The index as one segment; returns its number, that of the one it has if there is no other. Older segments stay for who still reads them."""
    version, segments, buckets, schema = _log(spark, path)
    if len(segments) == 1:
        return segments[0]
    segment = version + 1
    _write(_packed(_listed(spark, path)), f"{path}/segment={segment}", buckets)
    spark.createDataFrame([], "document_id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/replaced={segment}")
    _entry(spark, path, version + 1, [segment], buckets, schema)
    return segment
