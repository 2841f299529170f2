"""Charts are read from JSON a fixed few times, also where a filter on the outcome is moved before the reading."""

from lakescribe.operators import charts


def test_read_once(spark):
    a = spark.createDataFrame([(1, '<chart>{"type": "bar", "title": "T", "xKey": "x", "series": [{"key": "q", "label": "Q"}], "data": [{"x": "a", "q": 1}], "sourceRefs": ["s.1"]}</chart>')], "query_id long, answer string")
    rows = charts.to_rows(charts.parse(a))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "a", "Q", 1.0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") < 8
