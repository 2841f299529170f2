"""Reports from cited answers: claims, risks, obligations, sources, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import topk
from .citations import MARKER, without_charts

MOST_RISKS, MOST_OBLIGATIONS, MOST_FINDINGS, MOST_SUMMARY, EXCERPT = 6, 6, 6, 2, 260
# Words of risks, of obligations, of how severe a risk is, and of answers that don't answer.
RISK = r"(?i)risk|issue|exposure|breach|failure|missing|concern|unclear|critical"
OBLIGATION = r"(?i)must|shall|required|obligation|notice|maintain|review|action|deadline"
HIGH, MEDIUM = r"(?i)critical|breach|immediate|material|high risk", r"(?i)may|could|review|unclear|missing|concern|risk"
NO_ANSWER = (
    "could not produce a source-cited answer", "do not contain enough", "does not contain enough", "not enough direct support", "not enough evidence", "no information about",
    "none of them include", "retrieved documents do not directly answer", "uploaded documents did not provide enough evidence", "uploaded documents do not provide enough evidence", "would need access to documents",
)


def claims(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """query_id, line, text, refs: a row for each line of an answer that cites a source; refs are the sources' numbers in order.

    resolved: query_id, marker, n.
    """
    lines = answers.select("query_id", F.posexplode(F.split(without_charts(F.col("answer")), "\n")).alias("_k", "_l"))
    flat = F.regexp_replace(F.regexp_replace(F.trim("_l"), r"^[-*]\s+", ""), r"^\d+\.\s+", "")
    lines = lines.select("query_id", (F.col("_k") + 1).alias("line"), flat.alias("_l")).where("_l <> '' and not startswith(_l, '#')")
    marks = lines.select("query_id", "line", F.posexplode(F.regexp_extract_all("_l", F.lit(f"({MARKER})"))).alias("_p", "marker"))
    refs = marks.join(resolved.select("query_id", "marker", "n").distinct(), ["query_id", "marker"]).groupBy("query_id", "line", "n").agg(F.min("_p").alias("_p"))
    refs = refs.groupBy("query_id", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "n"))), lambda x: x["n"]).alias("refs"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_l", MARKER, ""), r"\s+", " "))
    return lines.join(refs, ["query_id", "line"]).select("query_id", "line", text.alias("text"), "refs").where("text <> ''")


def severity(text: Column) -> Column:
    return F.when(text.rlike(HIGH), "high").when(text.rlike(MEDIUM), "medium").otherwise("low")


def risk_register(claimed: DataFrame, most: int = MOST_RISKS) -> DataFrame:
    """query_id, rank, line, text, severity: an answer's claims that speak of risks, or all if none does; the first most."""
    speaks = F.col("text").rlike(RISK)
    any_one = F.bool_or(speaks).over(Window.partitionBy("query_id"))
    chosen = claimed.withColumn("_any", any_one).where(~F.col("_any") | speaks).drop("_any")
    return topk.per_group(chosen, ["query_id"], [F.col("line")], most).select("query_id", "rank", "line", "text", severity(F.col("text")).alias("severity"))


def obligations(claimed: DataFrame, most: int = MOST_OBLIGATIONS) -> DataFrame:
    return topk.per_group(claimed.where(F.col("text").rlike(OBLIGATION)), ["query_id"], [F.col("line")], most).select("query_id", "rank", "line", F.col("text").alias("action"))


def source_bundle(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, number, chunk_id, excerpt: an answer's sources by first citation; without any, as they were retrieved.

    resolved: query_id, place, chunk_id; sources: query_id, n, chunk_id, content.
    """
    cited = resolved.groupBy("query_id", "chunk_id").agg(F.min("place").alias("_at"))
    retrieved = sources.select("query_id", "chunk_id", F.col("n").alias("_at")).join(cited.select("query_id").distinct(), "query_id", "left_anti")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("_at"))
    chosen = cited.unionByName(retrieved.select("query_id", "chunk_id", F.col("_at").cast("int").alias("_at")), allowMissingColumns=True).withColumn("number", number).drop("_at")
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    short = F.when(F.length(flat) > EXCERPT, F.concat(F.rtrim(F.substring(flat, 1, EXCERPT - 1)), F.lit("…"))).otherwise(flat)
    return chosen.join(sources.select("query_id", "chunk_id", short.alias("excerpt")).dropDuplicates(["query_id", "chunk_id"]), ["query_id", "chunk_id"])


def is_insufficient(answer: Column) -> Column:
    flat = F.lower(F.regexp_replace(answer, r"\s+", " "))
    return F.exists(F.array(*[F.lit(x) for x in NO_ANSWER]), lambda x: F.contains(flat, x))


def is_supported(answers: DataFrame) -> DataFrame:
    """answers (answer, evidence_status, n_sources) with supported: answered, from enough evidence, with a source."""
    weak = F.coalesce(F.col("evidence_status").isin("weak", "none"), F.lit(False))
    return answers.withColumn("supported", ~weak & ~is_insufficient(F.col("answer")) & (F.col("n_sources") > 0))


def _refs(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")


def risk_report(claimed: DataFrame) -> DataFrame:
    """query_id, markdown: summary, findings, risk register and obligations of each answer."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("line"))
    risky = F.col("text").rlike(RISK)
    marked = claimed.withColumn("_k", order).withColumn("_any", F.bool_or(risky).over(Window.partitionBy("query_id")))
    marked = marked.withColumn("_risk", ~F.col("_any") | risky).withColumn("_duty", F.col("text").rlike(OBLIGATION))
    row = F.struct("_k", "text", "refs", "_risk", "_duty", severity(F.col("text")).alias("severity"))
    one = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("_c"))
    bullet = lambda c: F.concat(F.lit("- "), c["text"], F.lit(" — Evidence: "), _refs(c["refs"]))
    line = lambda c: F.concat(F.lit("| "), c["severity"], F.lit(" | "), c["text"], F.lit(" | "), _refs(c["refs"]), F.lit(" |"))
    some = lambda test, most: F.slice(F.filter("_c", test), 1, most)
    duties = some(lambda c: c["_duty"], MOST_OBLIGATIONS)
    return one.select(
        "query_id",
        F.concat(
            F.lit("## Executive Summary\n\n"), F.array_join(F.transform(F.slice("_c", 1, MOST_SUMMARY), bullet), "\n"),
            F.lit("\n\n## Key Findings\n\n"), F.array_join(F.transform(F.slice("_c", 1, MOST_FINDINGS), bullet), "\n"),
            F.lit("\n\n## Risk Register\n\n| Severity | Risk / issue | Evidence |\n| --- | --- | --- |\n"), F.array_join(F.transform(some(lambda c: c["_risk"], MOST_RISKS), line), "\n"),
            F.lit("\n\n## Obligations / Actions\n\n"),
            F.when(F.size(duties) > 0, F.array_join(F.transform(duties, bullet), "\n")).otherwise("No explicit obligations or actions were identified in the cited passages."),
        ).alias("markdown"),
    )


TEMPLATES = {"answer_report": "Answer Report", "evidence_summary": "Evidence Summary", "action_brief": "Action Brief", "comparison": "Comparison"}


def render(answers: DataFrame, bundle: DataFrame, template: str = "answer_report") -> DataFrame:
    """query_id, markdown: question, answer without charts and numbered sources with excerpts, under a template's title."""
    listed = F.sort_array(F.collect_list(F.struct("number", "excerpt")))
    own = bundle.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda s: F.concat(F.lit("["), s["number"].cast("string"), F.lit("] "), s["excerpt"])), "\n").alias("_s"))
    body = F.concat(F.lit(f"# {TEMPLATES[template]}\n\n## Question\n\n"), "question", F.lit("\n\n## Answer\n\n"), F.trim(without_charts(F.col("answer"))), F.lit("\n\n## Sources\n\n"), F.coalesce("_s", F.lit("None.")))
    return answers.join(own, "query_id", "left").select("query_id", body.alias("markdown"))
