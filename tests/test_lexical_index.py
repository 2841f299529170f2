"""A stored index of postings: read without the documents, brought up to date, made one."""

import pytest

from lakescribe.operators import lexical, lexical_index

KEYS = ["chunk_id", "document_id", "collection_id"]


def _postings(spark, rows):
    c = spark.createDataFrame([(10 * k, k, "c", text) for k, text in rows], "chunk_id long, document_id long, collection_id string, content string")
    return lexical.build_postings(c, KEYS, {"content": "content"}), c.select("document_id")


def _found(df):
    return sorted((r["document_id"], r["term"], r["pos"]) for r in df.collect())


def test_deltas_and_compaction(spark, tmp_path):
    path = f"{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        lexical_index.read(spark, path)
    lexical_index.add(*_postings(spark, [(1, "red stones"), (2, "blue stones"), (3, "old rivers")]), path, 4)
    lexical_index.add(*_postings(spark, [(2, "blue hills"), (4, "red hills")]), path)
    gone = spark.createDataFrame([(3,)], "document_id long")
    lexical_index.add(_postings(spark, [(9, "x")])[0].where("false"), gone, path)  # a document that is no more
    want = [(1, "red", 0), (1, "stones", 1), (2, "blue", 0), (2, "hills", 1), (4, "hills", 1), (4, "red", 0)]
    assert _found(lexical_index.read(spark, path)) == want
    assert _found(lexical_index.read(spark, path, ["red", "stones", "nowhere"])) == [x for x in want if x[1] in ("red", "stones")]
    reader = lexical_index.read(spark, path)
    lexical_index.compact(spark, path)
    assert _found(lexical_index.read(spark, path)) == want == _found(reader)
    lexical_index.add(*_postings(spark, [(1, "green")]), path)
    assert _found(lexical_index.read(spark, path, ["green", "red"])) == [(1, "green", 0), (4, "red", 0)]


def test_reading_is_a_scan_of_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/index"
    lexical_index.add(*_postings(spark, [(k, f"word{k} common") for k in range(200)]), path, 32)
    plan = lexical_index.read(spark, path, ["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "PushedFilters" in plan
    files = lexical_index.read(spark, path, ["word7"]).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) >= 1 and lexical_index.read(spark, path, ["word7"]).count() == 1


def test_chunks_without_a_row_for_each_word(spark, tmp_path, monkeypatch):
    """add_chunks() stores what add() of all postings does, a term of many chunks in few rows, and neither writing nor making one shuffles them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical_index, "TOGETHER", 3)
    rows = [(10 * k, k % 7, "c", text, f"n-{k}.txt") for k, text in enumerate(["red red stones", "", None, "Ünder  stones; red", "blue", " ", "red blue red"] * 5)]
    c = spark.createDataFrame(rows, "chunk_id long, document_id long, collection_id string, content string, filename string").repartition(3, "chunk_id")
    fields, d = {"filename": "filename", "content": "content"}, c.select("document_id")
    late = c.where("document_id < 2").withColumn("content", F.lit("green red green"))
    index, plain = f"{tmp_path}/a", f"{tmp_path}/b"
    lexical_index.add_chunks(c, KEYS, fields, d, index, 4)
    lexical_index.add(lexical.build_postings(c, KEYS, fields), d, plain, 4)
    lexical_index.add_chunks(late, KEYS, fields, late.select("document_id"), index)
    lexical_index.add(lexical.build_postings(late, KEYS, fields), late.select("document_id"), plain)
    every = lambda path: sorted(map(str, lexical_index.read(spark, path).select(*KEYS, "field", "pos", "term", "weight").collect()))
    want = every(plain)
    assert len(want) > 100 and every(index) == want
    assert spark.read.parquet(f"{index}/segment=1").where("field = 'content'").count() < c.join(lexical_index.read(spark, index), "chunk_id").where("field = 'content'").count()
    one = lexical_index.compact(spark, index)
    assert every(index) == want and lexical_index.compact(spark, index) == one
    plan = lexical_index._packed_chunks(c, KEYS, fields)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the table's own
