"""Words are counted where they are read: none becomes a row by its place."""

from lakescribe.operators import lexical


def test_counted_in_place(spark):
    c = spark.createDataFrame([(1, "Red stones, red", "red.txt"), (2, None, "a.txt"), (3, "", None), (4, "old red", "a.txt")], "chunk_id long, content string, filename string")
    found = lexical.term_statistics(c, {"content": "content", "filename": "filename"})
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r["field"], r["term"]): (r["n_chunks"], r["n_positions"], r["last_pos"], round(r["weight"], 6)) for r in found.collect()}
    assert rows == {
        ("content", "red"): (2, 3, 2, 0.6), ("content", "stones"): (1, 1, 1, 0.2), ("content", "old"): (1, 1, 0, 0.2),
        ("filename", "red"): (1, 1, 0, 1.0), ("filename", "a"): (2, 2, 0, 2.0), ("filename", "txt"): (3, 3, 1, 3.0),
    }
