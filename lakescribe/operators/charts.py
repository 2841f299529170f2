"""Charts in answers: one block of JSON that must hold together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_SERIES, MOST_REFS = 12, 2, 8
SCHEMA = "type string, title string, xKey string, yAxisLabel string, insight string, series array<struct<key:string,label:string,color:string>>, data array<map<string,string>>, sourceRefs array<string>"
NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def parse(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, maybe n_sources) with n_charts, chart (struct or null) and reason (null if all is well).

    The first rule that is broken is the reason. n_sources: how many sources may be referred to; null: any.
    """
    allowed = F.coalesce(F.col("n_sources"), F.lit(1 << 30)) if "n_sources" in answers.columns else F.lit(1 << 30)
    cut = lambda raw: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.get(raw, 0), r"^\s+|\s+$", "")), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    read = lambda body: F.struct(body.alias("body"), F.from_json(body, SCHEMA, {"mode": "PERMISSIVE"}).alias("c"))
    raw = F.regexp_extract_all("answer", F.lit(r"<chart>([\s\S]*?)</chart>"))
    found = _once(raw, lambda r: F.struct(F.size(r).alias("n_charts"), _once(_once(cut(r), read), lambda x: _judged(x["body"], x["c"], F.size(r), allowed)).alias("x")))
    out = answers.select("*", found.alias("_f")).select("*", "_f.n_charts", "_f.x.reason", "_f.x.chart").drop("_f")
    return out.withColumn("bad_chart", F.col("reason").isNotNull())


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed once however often it stands there, also where Spark moves a filter on the outcome before it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _judged(body: Column, c: Column, n_charts: Column, allowed: Column) -> Column:
    """chart and reason of one block of JSON and what was read of it."""
    keys, x_key = F.transform(c["series"], lambda s: F.trim(s["key"])), F.trim(c["xKey"])
    names = F.struct(keys.alias("keys"), x_key.alias("x_key"))
    return _once(names, lambda n: _ruled(body, c, n["keys"], n["x_key"], n_charts, allowed))


def _ruled(body: Column, c: Column, keys: Column, x_key: Column, n_charts: Column, allowed: Column) -> Column:
    rows_ok = F.forall(c["data"], lambda r: _text(F.element_at(r, x_key)))
    numbers_ok = F.forall(c["data"], lambda r: F.forall(keys, lambda k: F.coalesce(F.element_at(r, k).rlike(NUMBER), F.lit(False))))
    reason = (
        F.when(n_charts > 1, "only_one_chart")
        .when(F.try_parse_json(body).isNull(), "invalid_json")
        .when(~F.coalesce(c["type"].isin("bar", "line", "area"), F.lit(False)), "type")
        .when(~F.coalesce(F.size(c["series"]).between(1, MOST_SERIES), F.lit(False)), "series_count")
        .when(F.exists(c["series"], lambda s: ~(_text(s["key"]) & _text(s["label"]))), "series_names")
        .when(F.exists(c["series"], lambda s: s["color"].isNotNull() & ~s["color"].isin("primary", "secondary")), "series_color")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "series_unique")
        .when(~(_text(c["title"]) & _text(c["xKey"])), "title_or_x_key")
        .when(~F.coalesce(F.size(c["data"]).between(1, MOST_ROWS), F.lit(False)), "row_count")
        .when(~rows_ok, "x_value")
        .when(~numbers_ok, "numbers")
        .when(~F.coalesce(F.size(c["sourceRefs"]) > 0, F.lit(False)), "source_refs_missing")
        .when(F.exists(c["sourceRefs"], lambda r: ~F.coalesce(r.rlike(r"^s\.\d+$"), F.lit(False))), "source_refs_format")
        .when(F.exists(c["sourceRefs"], lambda r: ~F.substring(r, 3, 12).cast("long").between(1, allowed)), "source_refs_unknown")
    )
    chart = F.struct(c["type"].alias("type"), F.trim(c["title"]).alias("title"), x_key.alias("x_key"), c["series"].alias("series"), c["data"].alias("data"), F.slice(F.array_distinct(c["sourceRefs"]), 1, MOST_REFS).alias("source_refs"))
    told = F.when(n_charts > 0, reason)
    return _once(told, lambda t: F.struct(F.when((n_charts == 1) & t.isNull(), chart).alias("chart"), t.alias("reason")))


def to_rows(charts: DataFrame) -> DataFrame:
    """query_id, row, x, series, value: a row for each point of each good chart."""
    rows = charts.where("chart is not null").select("query_id", "chart", F.posexplode("chart.data").alias("row", "_r"))
    points = rows.select("query_id", "row", F.element_at("_r", F.col("chart.x_key")).alias("x"), "_r", F.explode("chart.series").alias("_s"))
    return points.select("query_id", "row", "x", F.col("_s.label").alias("series"), F.element_at("_r", F.trim("_s.key")).cast("double").alias("value"))
