"""Keyword search in one reading of each chunk gives the scores of looking at each pair."""

import random

from pyspark.sql import functions as F

from lakescribe.operators import keyword


def test_equal_to_pairs(spark):
    rnd = random.Random(3)
    stems = "report audit polici entr secur aaaa ab invoic stud running supplies budget need".split()
    word = lambda: rnd.choice(stems) + rnd.choice(["", "s", "ies", "ing", "ed", "y", "aaa"])
    text = lambda n: " ".join(word() for _ in range(n))
    q = [(k, rnd.choice("xy"), rnd.choice([text(rnd.randrange(1, 5)), "CTO " + text(2), "of the", None])) for k in range(60)]
    c = [(k, rnd.choice("xyz"), f"{word()}-{k}.txt", 0, rnd.choice([text(rnd.randrange(1, 12)), (q[k % 60][2] or "") + " " + text(3), "", None])) for k in range(150)]
    asked, had = spark.createDataFrame(q, "query_id long, scope string, question string"), spark.createDataFrame(c, "chunk_id long, scope string, filename string, chunk_index int, content string")
    keys = ["chunk_id", "filename", "chunk_index"]
    rows = lambda df: sorted(tuple(r) for r in df.where("keyword_score > 0").select("query_id", "chunk_id", "keyword_score").collect())
    pairs = keyword.candidates(asked, had, ["scope"], ["chunk_id"])
    want = rows(keyword.score(pairs))
    assert want
    for block in (64, 3):
        assert rows(keyword.search(asked, had, ["scope"], keys, block=block)) == want
    name = keyword.filename_terms(F.col("filename"))
    own = keyword.score(pairs.withColumn("own", F.array_except(keyword.search_terms(F.col("question")), name)), terms="own")
    assert rows(keyword.search(asked, had, ["scope"], keys, without=name)) == rows(own)
    assert keyword.search(asked.where("false"), had, ["scope"], keys).count() == 0 and keyword.search(asked, had.where("false"), ["scope"], keys).count() == 0


def test_no_shuffle_of_chunks_by_letters(spark):
    """A chunk's words and letters never become rows, and pairs are never joined to texts again."""
    q = spark.createDataFrame([(1, "x", "budget report")], "query_id long, scope string, question string")
    c = spark.createDataFrame([(1, "x", "f", 0, "the budget")], "chunk_id long, scope string, filename string, chunk_index int, content string")
    plan = keyword.search(q, c, ["scope"], ["chunk_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_a_chunk_without_words_is_like_no_question(spark):
    """Its cosine would be 0 / 0; the SQL of the fused queries has NaN for it there and ranks it first."""
    questions = spark.createDataFrame([(1, "s", "steel bridge")], "query_id long, collection_id string, question string")
    chunks = spark.createDataFrame([(1, "s", "éèç éèç éèç"), (2, "s", "a bridge of steel"), (3, "s", "")], "chunk_id long, collection_id string, content string")
    found = keyword.search(questions, chunks, ["collection_id"], ["chunk_id"]).select("chunk_id", "term_cosine").collect()
    assert [(r.chunk_id, r.term_cosine) for r in found] == [(2, 0.707107)]
