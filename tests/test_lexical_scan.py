"""What a scan of chunks sums for questions is what a search of their postings does."""

import random

from lakescribe.operators import lexical


def test_equal_to_search(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["river", "stone", "Harbour", "hill's", "INC-77", "red", "the"])
    text = lambda n: " ".join(word() for _ in range(rnd.randrange(n)))
    c = [(k, rnd.choice(["a", "b", None]), text(15), f"{word()}-{k}.txt") for k in range(150)]
    q = [(k, rnd.choice(["a", "b", "c", None]), rnd.choice(["%s", '"%s"', '%s "red stone"', '"river river" %s']) % text(4)) for k in range(90)]
    chunks = spark.createDataFrame(c, "chunk_id long, collection_id string, content string, filename string")
    clauses = lexical.question_clauses(spark.createDataFrame(q, "query_id long, collection_id string, question string"), ["collection_id"])
    fields = {"content": "content", "filename": "filename"}
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["rank"], 9)) for r in df.collect())
    want = rows(lexical.search(clauses, lexical.build_postings(chunks, ["chunk_id", "collection_id"], fields), ["collection_id"], ["chunk_id"]))
    for block in (64, 5):
        assert rows(lexical.ranked(lexical.scan(clauses, chunks, ["collection_id"], ["chunk_id"], fields, block))) == want
    assert want


def test_words_never_become_rows(spark):
    """A chunk gives a row for each question however often it has its words."""
    c = spark.createDataFrame([(1, "a", "red " * 300), (2, "a", None), (3, None, "red")], "chunk_id long, collection_id string, content string")
    q = spark.createDataFrame([(1, "a", "red stones")], "query_id long, collection_id string, question string")
    found = lexical.scan(lexical.question_clauses(q, ["collection_id"]), c, ["collection_id"], ["chunk_id"], {"content": "content"})
    assert [tuple(r) for r in found.selectExpr("query_id", "chunk_id", "round(r, 6)", "named").collect()] == [(1, 1, 60.0, 0)]
