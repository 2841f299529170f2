"""Documents found by pieces of their names are those that a look at every pair finds."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lakescribe.operators import matching


def test_equal_to_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["report", "rep", "a1", "x", "annual", "annualreport", "été", "2024", "plan", "planning", "of", "notes", "no", "budget-q1", "q1"]
    name = lambda: "-".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) + rnd.choice([".pdf", ".md", ".txt", ".csv", "", ".xlsx"])
    docs = spark.createDataFrame([(k, f"c{k % 2}", name()) for k in range(150)], "document_id long, collection_id string, filename string")
    asks = ["do I have the {}", "is there a pdf", "show me any csv or xlsx", "what of {} and {}", "{}", "files", "x", "the plan for reporting in 2024 pdf", "a 1", ""]
    questions = spark.createDataFrame([(k, f"c{k % 3}", asks[k % len(asks)].format(name(), rnd.choice(words))) for k in range(60)], "query_id long, collection_id string, question string")
    found = sorted(map(tuple, matching.match_documents(questions, docs, ["collection_id"]).collect()))
    monkeypatch.setattr(matching, "_candidates", lambda q, d, scope, _: q.select("query_id", *scope).join(d.select(*scope, "document_id"), scope))
    assert found == sorted(map(tuple, matching.match_documents(questions, docs, ["collection_id"]).collect())) and len(found) > 300


def test_few_pairs_are_looked_at(spark):
    docs = spark.range(3000).select(F.col("id").alias("document_id"), F.lit("c").alias("collection_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(".txt")).alias("filename"))
    first = docs.where("document_id % 1000 = 7")
    questions = first.select(F.col("document_id").alias("query_id"), "collection_id", F.concat(F.lit("where is "), F.regexp_replace("filename", r"\\.txt", "")).alias("question"))
    pairs = matching._candidates(questions, docs, ["collection_id"], None)
    assert pairs.count() < 0.3 * 3 * 3000
    best = matching.match_documents(questions, docs, ["collection_id"], matching.name_index(docs, ["collection_id"])).where("is_best and match_class in ('exact', 'strong')")
    assert sorted(r["document_id"] for r in best.collect()) == [7, 1007, 2007]


def test_sentences_stand_together():
    source = Path(matching.__file__).read_text()
    body = source[source.index("def existence_answer") :]
    assert '"I found' not in body and '"I do not' not in body
