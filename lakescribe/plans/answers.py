"""Queries over answers, prompts, reports, evaluation and whole selections, and over small column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions import query as q
from ..functions import text as t
from ..operators import chat, citations, context, evaluate, evidence, jobs, matching, reports
from .common import QUESTIONS, documents, questions, table
from .evidence import _ANSWERS, _answers, _relevant, _retrieved, _retrieved_metrics, _sources, retrieved_metrics
from .operations import _PAIRS


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents 1 to 3 that each answer had to cite, those that it doesn't."""
    cited = citations.resolve(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("query_id", F.col("n").alias("document_id"))
    required = _answers(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("document_id"))
    return citations.missing_required(cited, required)


MISSING_REQUIRED = f"""
WITH {_ANSWERS}, m AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[\\[[sp]\\.(\\d+)\\]\\]', 1))::INTEGER AS d, unnest(regexp_extract_all(answer, '\\[\\[([sp])\\.\\d+\\]\\]', 1)) AS k FROM answers),
r AS (SELECT query_id, unnest([1, 2, 3]) AS d FROM answers)
SELECT r.query_id, r.d AS document_id FROM r LEFT JOIN (SELECT DISTINCT query_id, d FROM m) x ON x.query_id = r.query_id AND x.d = r.d WHERE x.d IS NULL
""".replace("\\\\", "\\")


def response_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth answer lacks evidence."""
    a = _answers(spark, sf_dir).select("query_id", "answer", F.array(F.lit("s.1"), F.lit("s.2")).alias("citations"), F.when(F.col("query_id") % 5 != 0, F.col("query_id") % 4 == 0).alias("insufficient"))
    return evidence.guard(a).select("query_id", F.md5("answer").alias("answer_md5"), F.array_join("citations", ",").alias("citations"))


RESPONSE_GUARD = f"""
WITH {_ANSWERS}, b AS (SELECT *, query_id % 5 <> 0 AND query_id % 4 = 0 AS bad FROM answers) SELECT query_id, md5(CASE WHEN bad THEN '{evidence.NO_ANSWER.replace("'", "''")}' ELSE answer END) AS answer_md5, CASE WHEN bad THEN '' ELSE 's.1,s.2' END AS citations FROM b
"""


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say they can't answer, have weak evidence or no source."""
    said = F.when(F.col("query_id") % 3 == 0, F.concat("answer", F.lit(" There is  NOT enough\nevidence here."))).otherwise(F.col("answer"))
    status = F.element_at(F.array(F.lit("strong"), F.lit("weak"), F.lit(None), F.lit("none")), (F.col("query_id") % 4 + 1).cast("int"))
    a = _answers(spark, sf_dir).select("query_id", said.alias("answer"), status.alias("evidence_status"), (F.col("query_id") % 7).alias("n_sources"))
    return reports.is_supported(a).select("query_id", "supported")


SUPPORTED = f"WITH {_ANSWERS} SELECT query_id, query_id % 4 IN (0, 2) AND query_id % 3 <> 0 AND query_id % 7 > 0 AS supported FROM answers"


def report_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers in all four templates."""
    a, s = _answers(spark, sf_dir), _sources(spark, sf_dir)
    bundle = reports.source_bundle(citations.resolve(a, s), s)
    out = None
    for template in reports.TEMPLATES:
        own = reports.render(a.withColumn("question", F.concat(F.lit("Question "), F.col("query_id").cast("string"))), bundle, template).select("query_id", F.lit(template).alias("template"), F.md5("markdown").alias("markdown_md5"))
        out = own if out is None else out.unionByName(own)
    return out


REPORT_TEMPLATES = f"""
WITH {_ANSWERS}, m AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[\\[[sp]\\.(\\d+)\\]\\]', 1))::BIGINT AS n, unnest(range(len(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')))) AS k FROM answers),
c AS (SELECT query_id, n, min(k) AS k FROM m WHERE n BETWEEN 1 AND 3 GROUP BY ALL), u AS (SELECT query_id, n, k FROM c UNION ALL SELECT query_id, n, n FROM (SELECT query_id, unnest([1, 2, 3])::BIGINT AS n FROM answers WHERE query_id NOT IN (SELECT query_id FROM c))),
b AS (SELECT query_id, string_agg('[' || r || '] Source text of chunk ' || n, chr(10) ORDER BY r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS r FROM u) GROUP BY query_id),
t AS (SELECT unnest([{", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in reports.TEMPLATES.items())}]) AS t)
SELECT query_id, t.k AS template, md5('# ' || t.v || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || 'Question ' || query_id || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || trim(answer, ' ') || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || s) AS markdown_md5
FROM answers JOIN b USING (query_id), t
""".replace("\\\\", "\\")


def rendered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of each answer as tags of a prompt, with labels of every kind."""
    n = F.col("n")
    label = context.location_label(
        F.when(n == 2, F.concat(F.lit(" Part "), n.cast("string"))), F.when(n == 1, F.lit("S")), F.when(n == 1, n), F.when(n == 1, n + 4), F.when(F.col("query_id") % 2 == 0, n.cast("int")), F.lit(6)
    )
    s = _sources(spark, sf_dir).select("query_id", n.alias("rank"), F.lit('a "b".txt').alias("filename"), label.alias("location"), F.concat(F.lit("x < y & </source> "), n.cast("string")).alias("content"))
    return context.render_sources(s).select("query_id", "prompt")


RENDERED_SOURCES = f"""
WITH {_ANSWERS}, s AS (SELECT query_id, n, CASE n WHEN 1 THEN 'Sheet S, rows 1-5' WHEN 2 THEN 'Part 2' ELSE CASE WHEN query_id % 2 = 0 THEN 'Page 3' ELSE 'Chunk 7' END END AS l FROM (SELECT query_id, unnest([1, 2, 3]) AS n FROM answers))
SELECT query_id, string_agg('<source id="s.' || n || '" document={{"n":"a \\"b\\".txt","l":"' || l || '"}}>' || chr(10) || 'x &lt; y &amp; &lt;/source&gt; ' || n || chr(10) || '</source>', chr(10) || chr(10) ORDER BY n) AS prompt FROM s GROUP BY query_id
"""


def asked_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: questions that name a role by either name, both or neither."""
    tail = F.element_at(F.array(F.lit(" of the CTO"), F.lit(" of the Chief  Technology Officer"), F.lit(" of the cto, our chief technology officer"), F.lit("")), (F.col("item_id") % 4 + 1).cast("int"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("name [EMAIL_1]"), tail).alias("question"))
    return b.select("item_id", F.array_join(q.role_concepts(F.col("question")), ",").alias("roles"), q.expand_roles(F.col("question")).alias("expanded"), F.array_join(q.lexical_variants(F.col("question")), " | ").alias("variants"))


ASKED_ROLES = """
SELECT item_id, CASE WHEN item_id % 4 < 3 THEN 'chief_technology_officer' ELSE '' END AS roles,
  'name [EMAIL_1]' || [' of the CTO chief technology officer', ' of the Chief  Technology Officer cto', ' of the cto, our chief technology officer', ''][item_id % 4 + 1] AS expanded,
  CASE WHEN item_id % 4 = 3 THEN 'name [EMAIL_1]' ELSE '[EMAIL_1] name' || CASE WHEN item_id % 4 = 2 THEN ' our' ELSE '' END || ' cto | [EMAIL_1] name' || CASE WHEN item_id % 4 = 2 THEN ' our' ELSE '' END || ' "chief technology officer"' END AS variants FROM benchmark
"""


def blocks_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with lines and spaces put in, normalised as blocks; maps as JSON with keys in order."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit(" a\t\tb"), key, F.lit("\r\n\r\n\r\n\r\n c  \r d\n\n"))
    return c.select("c_custkey", t.normalize_block(text).alias("block"), files.canonical_json(F.create_map(F.lit("z"), key, F.lit("a"), F.lit("1"), F.lit("m"), F.lit(None).cast("string"))).alias("json"), files.fingerprint(key).alias("fingerprint"))


BLOCKS_AND_JSON = """
SELECT c_custkey, 'a b' || c_custkey || chr(10) || chr(10) || 'c' || chr(10) || 'd' AS block, '{"a":"1","m":null,"z":"' || c_custkey || '"}' AS json, sha256(c_custkey::VARCHAR) AS fingerprint FROM customer
"""


def private_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18 of masked columns: the questions' and answers' hashes stand for their masked texts."""
    p = chat.pair_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").withColumn("safe_q", F.md5("question")).withColumn("safe_a", F.md5("answer"))
    return chat.transcript(p, ["conv_id"], title="Private", question="safe_q", answer="safe_a")


PRIVATE_TRANSCRIPT = f"""
WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY answer_at) AS k FROM pairs)
SELECT conv_id, '# Private' || chr(10) || chr(10) || string_agg('## Question ' || k || chr(10) || chr(10) || md5(question) || chr(10) || chr(10) || '### Answer' || chr(10) || chr(10) || md5(answer), chr(10) || chr(10) ORDER BY k) AS markdown FROM n GROUP BY conv_id
"""


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the means of the ranking metrics of what retrieve() finds, against the gates."""
    g = evaluate.gates(evaluate.mean(retrieved_metrics(spark, sf_dir)))
    return g.select("metric", F.round("value", 5).alias("value"), "threshold", "passed")


QUALITY_GATES = f"""
WITH {_retrieved(False)}, {_relevant(5)}, {_retrieved_metrics("fused", 5, "own")},
g AS (SELECT 'hit' AS metric, avg(hit) AS value, 1.0::DOUBLE AS threshold FROM own UNION ALL SELECT 'mrr', avg(mrr), 0.95 FROM own UNION ALL SELECT 'ndcg', avg(ndcg), 0.95 FROM own UNION ALL SELECT 'precision', avg(precision), 0.45 FROM own UNION ALL SELECT 'recall', avg(recall), 0.9 FROM own)
SELECT metric, round(value, 5) AS value, threshold, coalesce(value >= threshold, false) AS passed FROM g
"""


def fusion_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: hits among the first three of retrieve() by ranks and by scores, over the same two lanes."""
    rows = [retrieved_metrics(spark, sf_dir, mode, 3).agg(F.round(F.avg("hit"), 6).alias("hit")).select(F.lit(mode).alias("mode"), "hit") for mode in jobs.FUSIONS]
    return rows[0].unionByName(rows[1])


FUSION_COMPARISON = f"""
WITH {_retrieved(False)}, {_relevant(3)}, {_retrieved_metrics("fused", 3, "byrank")}, {_retrieved_metrics("byscore", 3, "bysum")}
SELECT 'rrf' AS mode, round(avg(hit), 6) AS hit FROM byrank UNION ALL SELECT 'weighted', round(avg(hit), 6) FROM bysum
"""


def existence_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a collection has a document that a question names."""
    number = (F.col("query_id") % 5 * 20 + F.col("query_id") % 20).cast("string")
    named = F.concat(F.lit("Do I have "), "collection_id", F.when(F.col("query_id") % 2 == 0, F.lit("-")).otherwise(F.lit("-zz")), number, F.lit(".txt?"))
    asked = questions(spark, sf_dir).withColumn("question", F.when(F.col("query_id") % 3 == 0, F.lit("Tell me of rivers")).when(F.col("query_id") % 3 == 1, F.lit("Is there any text file?")).otherwise(named))
    return matching.existence_answer(asked, documents(spark, sf_dir).drop("text"), ["collection_id"])


EXISTENCE_ANSWER = f"""
WITH {QUESTIONS}, d AS (SELECT source AS collection_id, source || '-' || doc_id || '.txt' AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
l AS (SELECT collection_id, max(n) AS n, string_agg('- ' || f, chr(10) ORDER BY k) FILTER (k <= 8) AS eight, string_agg('`' || f || '`', ', ' ORDER BY k) FILTER (k <= 3) AS three FROM d GROUP BY collection_id),
a AS (SELECT query_id, collection_id, query_id % 5 * 20 + query_id % 20 AS x FROM questions WHERE query_id % 3 <> 0)
SELECT a.query_id, CASE WHEN l.n IS NULL THEN 'I do not see any uploaded documents in this workspace yet.' WHEN query_id % 3 = 1 THEN 'I found ' || l.n || ' matching ' || CASE WHEN l.n = 1 THEN 'file' ELSE 'files' END || ':' || chr(10) || chr(10) || eight
  WHEN query_id % 2 = 0 AND d.f IS NOT NULL THEN 'Yes. I found `' || d.f || '`.'
  ELSE 'I found text files in this workspace, including ' || three || ', but I do not see one matching ''' || a.collection_id || ' ' || CASE WHEN query_id % 2 = 0 THEN '' ELSE 'zz' END || x || '''.' END AS answer
FROM a LEFT JOIN l ON l.collection_id = a.collection_id LEFT JOIN d ON d.collection_id = a.collection_id AND d.f = a.collection_id || '-' || x || '.txt'
"""


QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "missing_required response_guard supported report_templates rendered_sources asked_roles blocks_and_json private_transcript quality_gates fusion_comparison existence_answer"
).split()}
