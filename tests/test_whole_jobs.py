"""Queries on small tables of literal rows that the given ones have no like of."""

from hashlib import md5

import duckdb

from lakescribe.plans import evidence, ingest


def _documents(spark, folder, texts):
    rows = [(k, t, "src1") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _lines(n):
    """A text of n words, a hundred to a line."""
    return "\n".join(" ".join(f"w{k}" for k in range(i, min(i + 100, n))) for i in range(0, n, 100))


def test_leaks_of_every_type(spark, tmp_path):
    """A number that only its label gives away is masked beside the label and stays where it is repeated."""
    texts = {1: "phone: 020 7946 0958, or ring 020 7946 0958", 2: "account no. 123456789012; quote 123456789012", 3: "phone: 020 7946 0959 once", 4: "mail a@b.org or a@b.org"}
    found = evidence.pii_leaks(spark, _documents(spark, tmp_path, texts)).collect()
    assert sorted(map(tuple, found)) == [("u1/document/1", "020 7946 0958"), ("u2/document/2", "123456789012")]


def test_pages_without_limit(spark, tmp_path):
    folder = _documents(spark, tmp_path, {1: _lines(20_020), 2: _lines(80_000), 3: "short", 4: " "})
    found = ingest.chunk_pages_whole(spark, folder)
    rows = sorted(map(tuple, found.collect()))
    # 8,000 words a page make 24 chunks, the last 4,020 of document 1 make 12
    assert [sum(r[0] == k for r in rows) for k in (1, 2, 3, 4)] == [60, 240, 1, 0]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    sql = f"SELECT {', '.join(found.columns)} FROM ({ingest.CHUNK_PAGES_WHOLE})"
    assert rows == sorted(duck.execute(sql).fetchall())


def test_ingest_to_masked_chunks(spark, tmp_path):
    texts = {1: "mail ann@example.org", 2: "mail ann@example.org", 4: _lines(20_020), 6: _lines(80_000), 8: " "}
    rows = evidence.ingest_job_chunks(spark, _documents(spark, tmp_path, texts)).collect()
    of = {k: [r for r in rows if r["document_id"] == k] for k in texts}
    assert {k: (len(x), x[0]["status"], x[0]["error"], x[0]["n_chunks"]) for k, x in of.items()} == {
        1: (1, "ready", None, 1), 2: (1, "ready", None, 1), 4: (60, "ready", None, 60), 6: (1, "failed", "too_many_chunks", 240), 8: (1, "failed", "no_text", 0),
    }
    assert sorted(r["chunk_index"] for r in of[4]) == list(range(60)) and of[6][0]["embedding_text_md5"] is None
    plain = md5(texts[1].encode()).hexdigest()
    assert (of[1][0]["embedding_projection"], of[1][0]["embedding_text_md5"]) == ("original", plain)
    assert of[2][0]["embedding_projection"] == "privacy_minimised" and of[2][0]["embedding_text_md5"] not in (plain, None)


def test_prompt_in_whole_budget(spark, tmp_path):
    """Of six chunks of 2,399 characters five fill the budget of 12,000, each of them whole."""
    folder = _documents(spark, tmp_path, {k: "river light harbors " * 119 + "river light harbors" for k in range(1, 7)})
    spark.createDataFrame([(1, "river light harbors")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [r["n"] for r in evidence.prompt_chunks(spark, folder).collect()] == [2399] * 5
