"""Markers in answers that cite sources: found, checked, resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER, LIKE, CHART = r"\[\[[sp]\.\d+\]\]", r"(?i)\[\[[sp]\.[^\s\]]*(?:\]\])?", r"(?is)<chart>.*?</chart>"


def parse(answer: Column) -> Column:
    """An array of structs of marker, type (s, p) and number, in order."""
    return F.transform(
        F.regexp_extract_all(answer, F.lit(f"({MARKER})")),
        lambda m: F.struct(m.alias("marker"), F.substring(m, 3, 1).alias("type"), F.regexp_extract(m, r"(\d+)", 1).cast("decimal(38,0)").alias("number")),
    )


def malformed(answer: Column) -> Column:
    """What begins like a marker but isn't one."""
    return F.filter(F.regexp_extract_all(answer, F.lit(f"({LIKE})")), lambda m: ~m.rlike(f"^{MARKER}$"))


def without_charts(answer: Column) -> Column:
    return F.regexp_replace(answer, CHART, "")


def validate(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, valid, invalid (distinct markers in order), missing, n_charts, rejected.

    answers: query_id, answer, maybe bad_chart (from charts.parse); sources: query_id, n (from 1), page_number. A source
    marker is valid up to the number of sources, a page marker if a source has that page.
    """
    own = sources.groupBy("query_id").agg(F.count("*").alias("_n"), F.collect_set("page_number").alias("_pages"))
    a = answers.join(own, "query_id", "left").select(
        *answers.columns, F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_pages", F.array().cast("array<bigint>")).cast("array<decimal(38,0)>").alias("_pages"),
        parse(F.col("answer")).alias("_m"), malformed(F.col("answer")).alias("_bad"), F.size(F.regexp_extract_all("answer", F.lit(f"({CHART})"))).alias("n_charts"),
    )
    resolves = lambda m: F.coalesce((m["number"] >= 1) & F.when(m["type"] == "s", m["number"] <= F.col("_n")).otherwise(F.array_contains("_pages", m["number"])), F.lit(False))
    names = lambda ms: F.array_distinct(F.transform(ms, lambda m: m["marker"]))
    bad_chart = F.coalesce(F.col("bad_chart"), F.lit(False)) if "bad_chart" in answers.columns else F.lit(False)
    out = a.select(
        "query_id", "n_charts", "_n",
        names(F.filter("_m", resolves)).alias("valid"),
        F.array_distinct(F.concat(names(F.filter("_m", lambda m: ~resolves(m))), "_bad")).alias("invalid"),
        ((F.trim(F.regexp_replace(without_charts(F.col("answer")), r"\s+", " ")) != "") & (F.size("_m") == 0) & (F.col("_n") > 0)).alias("missing"),
        bad_chart.alias("_bad_chart"),
    )
    return out.withColumn("rejected", (F.size("invalid") > 0) | F.col("missing") | F.col("_bad_chart")).drop("_n", "_bad_chart")


def resolve(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, place, marker, n, chunk_id: what each valid marker outside charts cites, by first use, each once.

    A page marker cites the first source of its page.
    """
    marked = answers.select("query_id", F.posexplode(parse(without_charts(F.col("answer")))).alias("_k", "_m")).select("query_id", "_k", "_m.*")
    pages = sources.where("page_number is not null").groupBy("query_id", F.col("page_number").alias("number")).agg(F.min_by(F.struct("n", "chunk_id"), "n").alias("_s")).select("query_id", "number", F.lit("p").alias("type"), "_s.*")
    numbers = sources.select("query_id", F.col("n").alias("number"), F.lit("s").alias("type"), "n", "chunk_id")
    found = marked.join(numbers.unionByName(pages).withColumn("number", F.col("number").cast("decimal(38,0)")), ["query_id", "type", "number"])
    first = found.groupBy("query_id", "marker", "n", "chunk_id").agg(F.min("_k").alias("_k"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_k"))).drop("_k")


def missing_required(cited: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, document_id that had to be cited and aren't."""
    return required.select("query_id", "document_id").distinct().join(cited.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
