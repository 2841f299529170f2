"""Queries over privacy, markup, citations, charts, reports, evaluation and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions import text as t
from ..operators import charts, citations, context, embed, evaluate, evidence, jobs, markup, pii, reports, topk
from ..sources.shared import kept
from ..streaming import limits
from . import retrieval
from .common import CHUNKS, chunks, documents, questions, table, tokens, workspace
from .operations import _EVENTS, _events

SECRET = "a secret of thirty-two characters, for tests only"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.withColumn("user_id", F.concat(F.lit("u"), (F.col("document_id") % 7).cast("string"))).withColumn("processing_mode", F.when(F.col("document_id") % 2 == 0, "privacy_minimised").otherwise("standard"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _owned(spark, sf_dir).select("document_id", pii.scope_id(F.col("user_id"), F.col("document_id")).alias("scope_id"), F.explode(pii.detect(F.col("text"))).alias("x"))
    return d.select("document_id", "scope_id", "x.*")


def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection in every document."""
    return _found(spark, sf_dir).select("document_id", "type", "start", "end", "rule_id", F.sha2("normalized", 256).alias("value_sha256"))


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document masked in its own scope."""
    d = _owned(spark, sf_dir)
    masked = pii.mask(F.col("text"), pii.scope_id(F.col("user_id"), F.col("document_id")), SECRET)
    return d.select("document_id", masked.alias("masked")).select("document_id", F.md5("masked").alias("masked_md5"), F.regexp_count("masked", F.lit(r"\[[A-Z]+_[0-9A-F]{10}_[0-9A-F]{10}\]")).alias("n_tokens"))


def pii_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pseudonyms of each document."""
    return pii.pseudonymize_sequential(_found(spark, sf_dir), SECRET).select("scope_id", "type", "token", F.sha2("value", 256).alias("value_sha256"))


def pii_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals of every type left in masked documents; empty unless a value that a label gives away stands elsewhere without it,
    or a checked number stands elsewhere beside other digits, with which it is no candidate (the SQL knows only the former)."""
    d = _owned(spark, sf_dir).withColumn("scope_id", pii.scope_id(F.col("user_id"), F.col("document_id")))
    payloads = d.select("scope_id", pii.mask(F.col("text"), F.col("scope_id"), SECRET).alias("text"))
    return pii.leaks(payloads, _found(spark, sf_dir))


#: Of the values that only a label gives away: phone and account numbers that stand once more without their label.
PII_LEAKS = r"""
WITH d AS (SELECT 'u' || (doc_id % 7) || '/document/' || doc_id AS scope_id, text FROM documents),
m AS (SELECT DISTINCT scope_id, text, unnest(regexp_extract_all(text, '(?i)\b(?:phone|account no\.?)\s*:?\s*(\d[\d ]{8,}\d)', 1)) AS value FROM d)
SELECT scope_id, value FROM m WHERE contains(regexp_replace(text, '(?i)\b(?:phone|account no\.?)\s*:?\s*\d[\d ]{8,}\d', '', 'g'), value)
"""


def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 on numbers made of the customers' keys."""
    number = F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 14, "0"), (F.col("c_custkey") % 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number")).select("c_custkey", pii.passes_luhn(F.col("number")).alias("passes"))


LUHN = """
WITH n AS (SELECT c_custkey, '4' || lpad((c_custkey * 7919)::VARCHAR, 14, '0') || (c_custkey % 10) AS s FROM customer),
d AS (SELECT c_custkey, s, unnest(range(1, 17)) AS i FROM n),
x AS (SELECT c_custkey, i, s[i]::INTEGER AS v, (16 - i) % 2 = 1 AS twice FROM d)
SELECT c_custkey, sum(CASE WHEN twice THEN CASE WHEN v * 2 > 9 THEN v * 2 - 9 ELSE v * 2 END ELSE v END) % 10 = 0 AS passes FROM x GROUP BY c_custkey
"""


def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each page."""
    u = markup.from_html(table(spark, sf_dir, "pages"), ["page_id"])
    return u.select("page_id", "unit_index", "block_type", F.md5("text").alias("text_md5"), F.size("heading_path").alias("depth"))


HTML_UNITS = r"""
WITH piece AS (SELECT page_id, unnest(string_split(html, '<')) AS x, unnest(range(len(string_split(html, '<')))) AS k FROM pages),
tag AS (SELECT page_id, k, lower(regexp_extract(x, '^(/?[a-zA-Z][a-zA-Z0-9]*|!--|!)', 1)) AS tag, regexp_extract(x, '(?s)^[^>]*>(.*)$', 1) AS text FROM piece WHERE k > 0),
ev AS (SELECT *, CASE WHEN tag IN ('li', 'h1', 'p') THEN k WHEN tag IN ('/li', '/h1', '/p', '/article', '/body', 'footer', 'div', 'nav') THEN -1 END AS e FROM tag),
run AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k) AS unit FROM ev),
txt AS (SELECT page_id, unit, k, tag, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS text FROM run WHERE unit > 0),
u AS (SELECT page_id, unit, min_by(tag, k) AS tag, string_agg(text, ' ' ORDER BY k) FILTER (text <> '') AS raw FROM txt GROUP BY ALL),
n AS (SELECT page_id, unit, tag, trim(regexp_replace(regexp_replace(regexp_replace(raw, '[ \t\x{00A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM u WHERE raw IS NOT NULL),
h AS (SELECT page_id, min(unit) FILTER (tag = 'h1') AS first_heading FROM n GROUP BY page_id)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY unit) - 1)::INTEGER AS unit_index, CASE tag WHEN 'li' THEN 'list_item' WHEN 'h1' THEN 'heading' ELSE 'paragraph' END AS block_type, md5(text) AS text_md5,
  (unit >= coalesce(first_heading, 1000000000))::INTEGER AS depth FROM n JOIN h USING (page_id) WHERE text <> ''
"""


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, uploads and paths made of the parts' names."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".MD", ".pdf", ".xls", ".exe", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", ends))
    checked = files.validate_upload(F.col("name"), F.col("p_size") * 200_000 - 200_000, F.when(F.col("p_partkey") % 4 == 0, "text/plain").otherwise(""))
    return p.select("p_partkey", files.extension(F.col("name")).alias("extension"), files.kind(F.col("name")).alias("kind"), checked.alias("u")).select("p_partkey", "extension", "kind", "u.status", "u.error")


FILE_KINDS = """
WITH p AS (SELECT p_partkey, (p_size * 200000 - 200000) AS size, ['.txt', '.md', '.pdf', '.xls', '.exe', ''][p_partkey % 6 + 1] AS e, p_partkey % 4 = 0 AS plain FROM part),
k AS (SELECT *, CASE e WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.pdf' THEN 'pdf' END AS kind FROM p),
r AS (SELECT *, CASE WHEN size <= 0 THEN 'empty_file' WHEN size > 15728640 THEN 'file_too_large' WHEN e = '.xls' THEN 'legacy_workbook' WHEN kind IS NULL THEN 'unsupported_type' WHEN plain AND kind = 'pdf' THEN 'mime_mismatch' WHEN kind IN ('text', 'markdown') AND size > 5242880 THEN 'kind_too_large' END AS error FROM k)
SELECT p_partkey, e AS extension, kind, CASE error WHEN 'empty_file' THEN 400 WHEN 'file_too_large' THEN 413 WHEN 'kind_too_large' THEN 413 WHEN 'legacy_workbook' THEN 415 WHEN 'unsupported_type' THEN 415 WHEN 'mime_mismatch' THEN 415 ELSE 200 END AS status, error FROM r
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of conversations with markers put at the ends of their lines by arithmetic."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    mark = F.concat(F.lit(" [[s."), (F.col("query_id") % 5).cast("string"), F.lit("]] [[p.2]]"))
    tail = F.when(F.col("query_id") % 4 == 0, F.lit("\nRisk remains [[s.1]]\nYou must act [[s.2]] [[s.x]]")).otherwise(F.lit(""))
    return a.select("query_id", F.when(F.col("query_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", mark, tail)).alias("answer"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of each answer, the second on page 2."""
    return _answers(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("query_id", "n", F.col("n").cast("long").alias("page_number"), (F.col("query_id") * 10 + F.col("n")).alias("chunk_id"), F.concat(F.lit("Source text of chunk "), F.col("n").cast("string")).alias("content"))


_ANSWERS = """a0 AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'assistant'),
answers AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN text ELSE text || ' [[s.' || (query_id % 5) || ']] [[p.2]]' || CASE WHEN query_id % 4 = 0 THEN chr(10) || 'Risk remains [[s.1]]' || chr(10) || 'You must act [[s.2]] [[s.x]]' ELSE '' END END AS answer FROM a0)"""


def citations_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5."""
    v = citations.validate(_answers(spark, sf_dir), _sources(spark, sf_dir))
    return v.select("query_id", F.array_join("valid", " ").alias("valid"), F.array_join("invalid", " ").alias("invalid"), "missing", "rejected")


CITATIONS_VALIDATE = f"""
WITH {_ANSWERS}, m AS (SELECT query_id, answer, unnest(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')) AS marker, unnest(range(len(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')))) AS k FROM answers),
v AS (SELECT query_id, marker, min(k) AS k, regexp_extract(marker, '(\\d+)', 1)::INTEGER BETWEEN 1 AND 3 AS ok FROM m GROUP BY query_id, marker),
s AS (SELECT query_id, coalesce(string_agg(marker, ' ' ORDER BY k) FILTER (ok), '') AS valid, string_agg(marker, ' ' ORDER BY k) FILTER (NOT ok) AS bad FROM v GROUP BY query_id),
j AS (SELECT a.query_id, coalesce(valid, '') AS valid, concat_ws(' ', bad, CASE WHEN contains(answer, '[[s.x]]') THEN '[[s.x]]' END) AS invalid, s.query_id IS NULL AND regexp_matches(answer, '\\S') AS missing FROM answers a LEFT JOIN s USING (query_id))
SELECT query_id, valid, invalid, missing, invalid <> '' OR missing AS rejected FROM j
""".replace("\\\\", "\\")


def citations_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6."""
    return citations.resolve(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("query_id", "place", "marker", "chunk_id")


CITATIONS_RESOLVE = f"""
WITH {_ANSWERS}, m AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')) AS marker, unnest(range(len(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')))) AS k FROM answers),
v AS (SELECT query_id, marker, min(k) AS k, regexp_extract(marker, '(\\d+)', 1)::BIGINT AS n FROM m GROUP BY query_id, marker)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k)::INTEGER AS place, marker, query_id * 10 + n AS chunk_id FROM v WHERE n BETWEEN 1 AND 3
""".replace("\\\\", "\\")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.claims(_answers(spark, sf_dir), citations.resolve(_answers(spark, sf_dir), _sources(spark, sf_dir)))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    return _claims(spark, sf_dir).select("query_id", "line", F.md5("text").alias("text_md5"), F.array_join("refs", ",").alias("refs"))


_CLAIMS = f"""{_ANSWERS}, l AS (SELECT query_id, unnest(string_split(answer, chr(10))) AS raw, unnest(range(1, len(string_split(answer, chr(10))) + 1))::INTEGER AS line FROM answers),
f AS (SELECT query_id, line, regexp_replace(regexp_replace(trim(raw), '^[-*]\\s+', ''), '^\\d+\\.\\s+', '') AS t FROM l),
mk AS (SELECT query_id, line, t, unnest(regexp_extract_all(t, '\\[\\[[sp]\\.\\d+\\]\\]')) AS m, unnest(range(len(regexp_extract_all(t, '\\[\\[[sp]\\.\\d+\\]\\]')))) AS k FROM f WHERE t <> '' AND t NOT LIKE '#%'),
rf AS (SELECT query_id, line, t, regexp_extract(m, '(\\d+)', 1)::INTEGER AS n, min(k) AS k FROM mk GROUP BY ALL),
claims AS (SELECT query_id, line, trim(regexp_replace(regexp_replace(t, '\\[\\[[sp]\\.\\d+\\]\\]', '', 'g'), '\\s+', ' ', 'g')) AS text, string_agg(n::VARCHAR, ',' ORDER BY k) AS refs FROM rf WHERE n BETWEEN 1 AND 3 GROUP BY query_id, line, t)""".replace("\\\\", "\\")
CLAIMS = f"WITH {_CLAIMS} SELECT query_id, line, md5(text) AS text_md5, refs FROM claims WHERE text <> ''"


def risk_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    return reports.risk_register(_claims(spark, sf_dir)).select("query_id", "rank", "line", "severity")


RISK_REGISTER = f"""
WITH {_CLAIMS}, r AS (SELECT *, regexp_matches(text, '(?i)risk|issue|exposure|breach|failure|missing|concern|unclear|critical') AS risky FROM claims WHERE text <> ''),
a AS (SELECT *, bool_or(risky) OVER (PARTITION BY query_id) AS any_one FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line)::INTEGER AS rank FROM a WHERE risky OR NOT any_one)
SELECT query_id, rank, line, CASE WHEN regexp_matches(text, '(?i)critical|breach|immediate|material|high risk') THEN 'high' WHEN regexp_matches(text, '(?i)may|could|review|unclear|missing|concern|risk') THEN 'medium' ELSE 'low' END AS severity FROM n WHERE rank <= 6
"""


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    return reports.obligations(_claims(spark, sf_dir)).select("query_id", "rank", "line")


OBLIGATIONS = f"""
WITH {_CLAIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line)::INTEGER AS rank FROM claims WHERE regexp_matches(text, '(?i)must|shall|required|obligation|notice|maintain|review|action|deadline'))
SELECT query_id, rank, line FROM n WHERE rank <= 6
"""


def source_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13."""
    return reports.source_bundle(citations.resolve(_answers(spark, sf_dir), _sources(spark, sf_dir)), _sources(spark, sf_dir)).select("query_id", "number", "chunk_id", "excerpt")


SOURCE_BUNDLE = f"""
WITH {_ANSWERS}, m AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[\\[[sp]\\.(\\d+)\\]\\]', 1))::BIGINT AS n, unnest(range(len(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')))) AS k FROM answers),
c AS (SELECT query_id, n, min(k) AS k FROM m WHERE n BETWEEN 1 AND 3 GROUP BY ALL), u AS (SELECT query_id, n, k FROM c UNION ALL SELECT query_id, n, n FROM (SELECT query_id, unnest([1, 2, 3])::BIGINT AS n FROM answers WHERE query_id NOT IN (SELECT query_id FROM c)))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k)::INTEGER AS number, query_id * 10 + n AS chunk_id, 'Source text of chunk ' || n AS excerpt FROM u
""".replace("\\\\", "\\")


def risk_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk report of each answer."""
    return reports.risk_report(_claims(spark, sf_dir)).select("query_id", F.md5("markdown").alias("markdown_md5"))


_LINE = "'- ' || text || ' — Evidence: ' || refs"
RISK_REPORTS = f"""
WITH {_CLAIMS}, c0 AS (SELECT query_id, line, text, '[' || replace(refs, ',', '], [') || ']' AS refs FROM claims WHERE text <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line) AS k, regexp_matches(text, '{reports.RISK}') AS risky, bool_or(regexp_matches(text, '{reports.RISK}')) OVER (PARTITION BY query_id) AS any_one, regexp_matches(text, '{reports.OBLIGATION}') AS duty FROM c0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, risky OR NOT any_one ORDER BY k) AS rk, row_number() OVER (PARTITION BY query_id, duty ORDER BY k) AS dk,
  CASE WHEN regexp_matches(text, '{reports.HIGH}') THEN 'high' WHEN regexp_matches(text, '{reports.MEDIUM}') THEN 'medium' ELSE 'low' END AS severity FROM c)
SELECT query_id, md5('## Executive Summary' || chr(10) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY k) FILTER (k <= 2) || chr(10) || chr(10) || '## Key Findings' || chr(10) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY k) FILTER (k <= 6)
  || chr(10) || chr(10) || '## Risk Register' || chr(10) || chr(10) || '| Severity | Risk / issue | Evidence |' || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce(string_agg('| ' || severity || ' | ' || text || ' | ' || refs || ' |', chr(10) ORDER BY k) FILTER ((risky OR NOT any_one) AND rk <= 6), '')
  || chr(10) || chr(10) || '## Obligations / Actions' || chr(10) || chr(10) || coalesce(string_agg({_LINE}, chr(10) ORDER BY k) FILTER (duty AND dk <= 6), 'No explicit obligations or actions were identified in the cited passages.')) AS markdown_md5 FROM n GROUP BY query_id
"""


def charts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts made of orders' lines, some broken by arithmetic; the points of the good ones."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_set(F.struct("l_partkey", "l_quantity"))).alias("v"))
    rows = F.array_join(F.transform("v", lambda x: F.concat(F.lit('{"x": "p'), x["l_partkey"].cast("string"), F.lit('", "q": '), x["l_quantity"].cast("string"), F.lit("}"))), ", ")
    kind = F.when(F.col("query_id") % 5 == 0, "pie").otherwise("bar")
    body = F.concat(F.lit('Text <chart>{"type": "'), kind, F.lit('", "title": "T", "xKey": "x", "series": [{"key": "q", "label": "Q"}], "data": ['), rows, F.lit('], "sourceRefs": ["s.'), (F.col("query_id") % 4).cast("string"), F.lit('"]}</chart>'))
    return charts.to_rows(charts.parse(n.select("query_id", body.alias("answer"), F.lit(3).alias("n_sources")))).select("query_id", "row", "x", "series", "value")


CHARTS_PARSE = """
WITH v AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1)::INTEGER AS row FROM v)
SELECT l_orderkey AS query_id, row, 'p' || l_partkey AS x, 'Q' AS series, l_quantity AS value FROM n WHERE c <= 12 AND l_orderkey % 5 <> 0 AND l_orderkey % 4 <> 0
"""


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, chunk_id, rank: the best chunks of each question by words."""
    found = retrieval.lexical_ranks(spark, sf_dir)
    return topk.per_group(found, ["query_id"], [F.desc("rank_score"), F.col("document_id"), F.col("chunk_index")], k).select("query_id", "chunk_id", "rank")


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's questions against their five best chunks by words."""
    q = questions(spark, sf_dir).withColumn("retrieval_reason", F.when(F.col("query_id") % 9 == 0, "broad_context_fallback").otherwise("hybrid_match"))
    s = _best(spark, sf_dir, 5).join(chunks(spark, sf_dir), "chunk_id").select("query_id", "document_id", "content", F.lit("keyword").alias("retrieval_mode"), F.lit(1.0).alias("relevance_score"), F.lit(1).alias("keyword_score"), F.lit(None).cast("double").alias("semantic_similarity"))
    return evidence.assess(q, s)


_STOPS = ", ".join(repr(x) for x in evidence.STOP_WORDS)
EVIDENCE_GATE = f"""
WITH {retrieval.RANKED}, rk AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, document_id, chunk_index) AS k FROM s) WHERE k <= 5),
s0 AS (SELECT query_id, content, {tokens('content')} AS words FROM rk JOIN chunks USING (chunk_id)),
ew AS (SELECT query_id, unnest({tokens('question')}) AS t, unnest(range(len({tokens('question')}))) AS p FROM questions),
ed AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) AS k FROM ew WHERE length(t) >= 4 AND t NOT IN ({_STOPS}) GROUP BY query_id, t),
et AS (SELECT * FROM ed WHERE k <= 12), en AS (SELECT query_id, count(*) AS n FROM et GROUP BY query_id),
ok AS (SELECT * FROM s0 WHERE length(array_to_string(words, ' ')) >= 24), ec AS (SELECT query_id, count(*) AS all_n, bool_or(length(content) > 3000) AS long FROM s0 GROUP BY query_id), em AS (SELECT query_id, count(*) AS n_meaningful FROM ok GROUP BY query_id),
eh AS (SELECT et.query_id, count(DISTINCT t) AS n_matched FROM et JOIN ok USING (query_id) WHERE list_contains(words, t) OR len(list_filter(words, lambda x: length(x) >= 5 AND (starts_with(x, t) OR starts_with(t, x)))) > 0 GROUP BY et.query_id),
ej AS (SELECT q.query_id, coalesce(n_meaningful, 0) AS n_meaningful, coalesce(n_matched, 0)::INTEGER AS n_matched, CASE WHEN n >= 4 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS n_needed, coalesce(all_n, 0) AS all_n, coalesce(long, false) AS long
  FROM questions q LEFT JOIN en USING (query_id) LEFT JOIN ec USING (query_id) LEFT JOIN em USING (query_id) LEFT JOIN eh USING (query_id)),
er AS (SELECT *, CASE WHEN all_n NOT BETWEEN 1 AND 10 OR long THEN 'out_of_bounds' WHEN n_meaningful = 0 THEN 'no_meaningful_source' WHEN query_id % 9 = 0 THEN 'broad_or_empty_retrieval' WHEN NOT (n_needed > 0 AND n_matched >= n_needed) THEN 'too_little_support' ELSE 'sufficient' END AS reason FROM ej)
SELECT query_id, n_meaningful, n_matched, n_needed, CASE WHEN reason = 'sufficient' THEN 'strong' WHEN n_meaningful > 0 THEN 'weak' ELSE 'none' END AS status, reason = 'sufficient' AS sufficient, reason FROM er
"""


def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question by words, within the budget."""
    ranked = _best(spark, sf_dir, 10).join(chunks(spark, sf_dir), "chunk_id").join(questions(spark, sf_dir).select("query_id", "question"), "query_id")
    return context.select_prompt_chunks(ranked).select("query_id", "chunk_id", F.md5("content").alias("content_md5"), F.length("content").alias("n"))


def passage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: which chunks hold which of the benchmark's passages."""
    p = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "passage_id")
    return evaluate.passage_support(chunks(spark, sf_dir), p).select("chunk_id", "passage_id", F.round("overlap", 6).alias("overlap"))


def _long(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) >= 4))"


_SUPPORT = f"{CHUNKS}, cw AS (SELECT chunk_id, document_id, {_long('content')} AS c FROM chunks), pw AS (SELECT item_id AS passage_id, {_long('text')} AS p FROM benchmark), sup AS (SELECT chunk_id, passage_id, len(list_intersect(c, p)) / len(p) AS o FROM cw, pw WHERE len(p) > 0 AND len(list_intersect(c, p)) / len(p) >= 0.7)"
PASSAGE_SUPPORT = f"WITH {_SUPPORT} SELECT chunk_id, passage_id, round(o, 6) AS overlap FROM sup"


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3: five chunks of each question by how much they hold of it, against all that hold 0.7."""
    p = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "passage_id")
    held = kept(evaluate.passage_support(chunks(spark, sf_dir), p, 0.5).withColumnRenamed("passage_id", "query_id"))  # read three times
    ranked = topk.per_group(held, ["query_id"], [F.desc(F.round("overlap", 9)), F.desc("chunk_id")], 5)
    relevant = held.where("overlap >= 0.7").select("query_id", "chunk_id", F.when(F.col("overlap") > 0.9, 2).otherwise(1).alias("grade"))
    m = evaluate.metrics(evaluate.grades(ranked, relevant), relevant)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("hit", "mrr", "recall", "precision", "ndcg")])


EVAL_METRICS = f"""
WITH {_SUPPORT.replace(">= 0.7)", ">= 0.5)")}, rel AS (SELECT passage_id AS query_id, chunk_id, CASE WHEN o > 0.9 THEN 2 ELSE 1 END AS grade FROM sup WHERE o >= 0.7),
rk AS (SELECT * FROM (SELECT passage_id AS query_id, chunk_id, row_number() OVER (PARTITION BY passage_id ORDER BY round(o, 9) DESC, chunk_id DESC) AS rank FROM sup) WHERE rank <= 5),
g AS (SELECT rk.*, coalesce(grade, 0) AS grade FROM rk LEFT JOIN rel USING (query_id, chunk_id)), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS r FROM rel),
id AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 5 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS ideal FROM i GROUP BY query_id),
t AS (SELECT query_id, count(*) FILTER (grade > 0) AS f, min(rank) FILTER (grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS gain FROM g GROUP BY query_id)
SELECT query_id, coalesce((f > 0)::INTEGER::DOUBLE, 0) AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(f / n, 0), 6) AS recall, round(coalesce(f / 5, 0), 6) AS precision, round(coalesce(gain / ideal, 0), 6) AS ndcg FROM id LEFT JOIN t USING (query_id)
"""


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: questions of which some have a word that no chunk has."""
    q = questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 2 == 0, F.concat("question", F.lit(" zyxwvut"))).otherwise(F.col("question")).alias("question"), (F.col("query_id") % 2 == 1).alias("answerable"))
    return evaluate.refusals(q, chunks(spark, sf_dir)).select("query_id", F.array_join("missing_terms", " ").alias("missing_terms"), "refuse", "right")


REFUSALS = f"""
WITH {CHUNKS}, k AS (SELECT DISTINCT unnest({_long('content')}) AS term FROM chunks), q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text || ' zyxwvut' ELSE text END AS question FROM benchmark),
w AS (SELECT query_id, unnest({_long('question')}) AS term FROM q), g AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS m FROM w WHERE term NOT IN (SELECT term FROM k) GROUP BY query_id)
SELECT query_id, coalesce(m, '') AS missing_terms, m IS NOT NULL AS refuse, (m IS NOT NULL) <> (query_id % 2 = 1) AS right FROM q LEFT JOIN g USING (query_id)
"""


def ingest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to chunks, the private ones masked; what became of each."""
    return jobs.ingest(_owned(spark, sf_dir), SECRET)[1]


INGEST_JOB = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
u AS (SELECT doc_id, k // 80 AS u, len(list_filter(string_split_regex(string_agg(line, ' '), '\s+'), lambda x: x <> '')) AS n FROM lines GROUP BY ALL),
f AS (SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS l, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN any_value(l) = 0 THEN 'no_text' WHEN any_value(l) < 10 OR any_value(w) < 2 THEN 'not_enough_content' END AS short, sum(CASE WHEN n = 0 THEN 0 WHEN n <= 384 THEN 1 ELSE ceil((n - 384) / 346) + 1 END)::BIGINT AS n_chunks FROM u JOIN f USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS document_id, CASE WHEN short IS NULL AND n_chunks <= 200 THEN 'ready' ELSE 'failed' END AS status, CASE WHEN short IS NOT NULL THEN 'validating' WHEN n_chunks > 200 THEN 'chunking' END AS failed_stage,
  CASE WHEN short IS NOT NULL THEN short WHEN n_chunks > 200 THEN 'too_many_chunks' END AS error, CASE WHEN short IS NULL THEN n_chunks ELSE 0 END AS n_chunks FROM c
"""


def ingest_job_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13, the whole job within the operator's own limit: each document's status with the texts of its chunks, the private ones masked; one row for a failed document."""
    done = jobs.process(_owned(spark, sf_dir))
    rows = done.select("document_id", "user_id", "processing_mode", "status", "failed_stage", "error", "n_chunks", F.posexplode_outer(F.when(F.col("status") == "ready", F.col("chunks"))).alias("chunk_index", "c"))
    masked = pii.projected(rows.select("*", "c.content").drop("c"), SECRET)
    projection = F.when(F.col("chunk_index").isNotNull(), F.col("embedding_projection"))
    return masked.select("document_id", "status", "failed_stage", "error", "n_chunks", "chunk_index", projection.alias("embedding_projection"), F.md5("embedding_text").alias("embedding_text_md5"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file about each document, of twelve sorts: four that are read, the others with one fault each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("brand"), F.concat(F.lit("Text in "), F.coalesce("lang", F.lit("none"))).alias("name"), F.coalesce("n_chars", F.lit(0)).cast("string").alias("size"))
    key, size = F.col("doc_id").cast("string"), F.col("size")
    sorts = [
        (".html", F.concat(F.lit("<head><title>T</title><script>x()</script></head><h1>"), "brand", F.lit("</h1><p>"), "name", F.lit("</p><p hidden>secret</p><table><tr><td>"), key, F.lit("<td>"), size, F.lit("</table>"))),
        (".md", F.concat(F.lit("# "), "brand", F.lit("\n\n**"), "name", F.lit("**\n\n| key | size |\n| --- | --- |\n| "), key, F.lit(" | "), size, F.lit(" |\n\n<script>\nx()\n</script>\n"))),
        (".csv", F.concat(F.lit("key,\"the \"\"name\"\"\"\r\n"), key, F.lit(",\""), "name", F.lit(",\nx\"\r\n,\r\n"), size, F.lit("\r\n"))),
        (".txt", F.concat(F.lit("Part\x07 "), "name", F.repeat(F.lit("\nline"), 100))),
        (".html", F.concat(F.lit("<p>"), "name", F.lit("<!DOCTYPE x [<!ENTITY e SYSTEM 'file:///x'>]>"))),
        (".exe", F.col("name")),
        (".txt", F.lit("x")),
        (".pdf", F.lit("abc")),
        (".csv", F.lit("only,names\n")),
        (".md", F.repeat(F.lit("word "), 1800)),
        (".md", F.lit("")),
        (".txt", F.concat(F.lit("a\x00b "), "name")),
    ]
    sort = F.col("doc_id") % len(sorts)
    filename, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (ending, body) in enumerate(sorts):
        filename, text = F.when(sort == k, F.concat(F.lit("file"), key, F.lit(ending))).otherwise(filename), F.when(sort == k, body).otherwise(text)
    mode = F.when(F.col("doc_id") % 2 == 0, "privacy_minimised").otherwise("standard")
    return d.select(F.col("doc_id").alias("document_id"), F.lit("u1").alias("user_id"), F.lit("c1").alias("collection_id"), filename.alias("filename"), mode.alias("processing_mode"), text.cast("binary").alias("content"))


def ingest_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13, U1 over files of every kind, as bytes: what became of each and the chunks of those that are ready, five at most."""
    done = jobs.process(_uploads(spark, sf_dir), most_chunks=5)
    rows = done.select("document_id", "kind", "status", "failed_stage", "error", "n_units", F.posexplode_outer(F.when(F.col("status") == "ready", F.col("chunks"))).alias("chunk_index", "c"))
    return rows.select("document_id", "kind", "status", "failed_stage", "error", "n_units", "chunk_index", "c.block_type", "c.location_label", F.array_join("c.heading_path", " > ").alias("headings"), "c.content")


INGEST_KINDS = r"""
WITH p AS (SELECT doc_id AS k, (doc_id % 12)::INTEGER AS s, coalesce(source, 'none') AS b, 'Text in ' || coalesce(lang, 'none') AS n, doc_id::VARCHAR AS key, coalesce(n_chars, 0)::VARCHAR AS size FROM documents),
read AS (SELECT k, s, unnest(CASE s
  WHEN 0 THEN [{'t': 'heading', 'l': 'Heading: ' || b, 'h': b, 'c': b}, {'t': 'paragraph', 'l': '/html[1]/body[2]/p[2]', 'h': b, 'c': n}, {'t': 'table_row', 'l': '/html[1]/body[2]/table[4]/tr[1]', 'h': b, 'c': key || ' ' || size}]
  WHEN 1 THEN [{'t': 'heading', 'l': 'Heading: ' || b, 'h': b, 'c': b}, {'t': 'paragraph', 'l': 'Line 3', 'h': b, 'c': n}, {'t': 'table_row', 'l': 'Line 7', 'h': b, 'c': 'key: ' || key || '; size: ' || size}, {'t': 'paragraph', 'l': 'Line 10', 'h': b, 'c': '[unsafe embedded HTML removed]'}]
  WHEN 2 THEN [{'t': 'table_row', 'l': 'Rows 2-3', 'h': NULL, 'c': 'Columns: key | the "name"' || chr(10) || 'Row 2: key: ' || key || '; the "name": ' || n || ',' || chr(10) || 'x' || chr(10) || 'Row 3: key: ' || size || '; the "name": [blank]'}]
  WHEN 3 THEN [{'t': 'text', 'l': 'Lines 1-80', 'h': NULL, 'c': 'Part ' || n || repeat(' line', 79)}, {'t': 'text', 'l': 'Lines 81-101', 'h': NULL, 'c': 'line' || repeat(' line', 20)}]
  END) AS x, unnest(range(CASE s WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 2 END))::INTEGER AS chunk_index FROM p WHERE s < 4)
SELECT k AS document_id, ['html', 'markdown', 'csv', 'text'][s + 1] AS kind, 'ready' AS status, NULL AS failed_stage, NULL AS error, count(*) OVER (PARTITION BY k)::INTEGER AS n_units, chunk_index, x.t AS block_type, x.l AS location_label, x.h AS headings, x.c AS content FROM read
UNION ALL SELECT k, ['html', NULL, 'text', 'pdf', 'csv', 'markdown', 'markdown', 'text'][s - 3], 'failed', CASE s WHEN 4 THEN 'extracting' WHEN 8 THEN 'extracting' WHEN 9 THEN 'chunking' ELSE 'validating' END,
  ['unsafe_markup', 'unsupported_type', 'not_enough_content', 'content_mismatch', 'no_text', 'too_many_chunks', 'no_text', 'binary_content'][s - 3], CASE s WHEN 6 THEN 1 WHEN 9 THEN 1 ELSE 0 END, NULL, NULL, NULL, NULL, NULL FROM p WHERE s > 3
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as rows of the model: all of one user, one in thirteen not ready, every other private."""
    d = documents(spark, sf_dir).drop("text")
    status = F.when(F.col("document_id") % 13 == 0, "processing").otherwise("ready")
    return d.withColumn("user_id", F.lit("u1")).withColumn("status", status).withColumn("processing_mode", F.when(F.col("document_id") % 2 == 1, "privacy_minimised").otherwise("standard"))


def retrieve_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with vectors of a hashing embedder, private documents masked."""
    c = pii.project_chunks(chunks(spark, sf_dir), _files(spark, sf_dir).drop("filename", "status"), SECRET)
    path = f"{workspace(spark)}/chunks"
    embed.embed_column(c.drop("filename", "user_id", "processing_mode"), "embedding_text").write.parquet(path)
    c = spark.read.parquet(path)
    q = embed.embed_column(questions(spark, sf_dir).withColumn("user_id", F.lit("u1")), "question", most=embed.QUESTION_CHARACTERS)
    found, _ = jobs.retrieve(q, c, _files(spark, sf_dir), SECRET)
    return found.select("query_id", "chunk_id", "final_rank", "reason")


def ranked_chunks(spark: SparkSession, sf_dir: str, mode: str = "rrf", required: bool = False) -> tuple[DataFrame, DataFrame]:
    """R19 over given vectors: chunks and questions have those of the embeddings whose ids follow from theirs. No document is
    private here, as SQL can't mask; every third question asks of two documents of its collection, if required."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("v"), "embedding")
    n = v.count()
    path = f"{workspace(spark)}/chunks"  # as a stored table, which retrieval reads by columns
    chunks(spark, sf_dir).drop("filename").write.parquet(path)
    c = spark.read.parquet(path).withColumn("provider_safe_content", F.lit(None).cast("string"))
    vectors = c.select("chunk_id", ((F.col("document_id") * 7 + F.col("chunk_index")) % n).alias("v")).join(v, "v").select("chunk_id", "embedding")
    q = questions(spark, sf_dir).withColumn("user_id", F.lit("u1")).withColumn("v", F.col("query_id") * 11 % n).join(v, "v").drop("v")
    if required:
        two = _files(spark, sf_dir).groupBy("collection_id").agg(F.array(F.min("document_id"), F.max("document_id")).alias("document_ids"))
        q = q.join(two, "collection_id", "left").withColumn("document_ids", F.when(F.col("query_id") % 3 == 0, F.col("document_ids")))
    return jobs.retrieve(q, c, _files(spark, sf_dir).withColumn("processing_mode", F.lit("standard")), SECRET, mode=mode, vectors=vectors)


_READY = CHUNKS.replace("FROM documents\n", "FROM documents WHERE doc_id % 13 <> 0\n")
#: SQL of both lanes over the vectors of ranked_chunks(), fused, as fused (by ranks) and ws (by scores); restricted: every third question to two documents.
def _retrieved(restricted: bool) -> str:
    from .common import QUESTIONS, norm, tokens as words, useful

    two = "two AS (SELECT source AS collection_id, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY source), scoped AS (SELECT questions.*, two.a, two.b, query_id % 3 = 0 AND two.a IS NOT NULL AS few FROM questions LEFT JOIN two USING (collection_id))"
    fits = "AND (NOT few OR document_id IN (a, b))" if restricted else ""
    return f"""{_READY}, {QUESTIONS}, {two},
pair AS (SELECT query_id, chunk_id, document_id, filename, chunk_index, few, a, b, {norm("content")} AS txt, {norm("question")} AS ask FROM scoped JOIN chunks USING (collection_id) WHERE true {fits}),
post AS (SELECT chunk_id, 0 AS named, 0.2::DOUBLE AS w, unnest({words("content")}) AS term FROM chunks UNION ALL SELECT chunk_id, 1, 1.0, unnest({words("filename")}) FROM chunks),
qt AS (SELECT query_id, unnest({useful(words('question[1:500]'))}) AS term FROM questions),
lx AS (SELECT query_id, chunk_id, document_id, chunk_index, sum(w) AS r, max(named) AS named FROM qt JOIN pair USING (query_id) JOIN post USING (chunk_id, term) GROUP BY ALL),
kw AS (SELECT query_id, chunk_id, keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, document_id, chunk_index, chunk_id) AS k FROM (SELECT *, round(r / (r + 1) + 0.25 * named, 6) AS keyword_score FROM lx)) WHERE k <= 20),
ev AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings),
sem AS (SELECT query_id, chunk_id, semantic_similarity FROM (SELECT query_id, chunk_id, round(c, 9) AS semantic_similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, chunk_id) AS k FROM
  (SELECT query_id, chunk_id, list_cosine_similarity(x.e, y.e) AS c FROM pair JOIN ev x ON x.vec_id = query_id * 11 % x.n JOIN ev y ON y.vec_id = (document_id * 7 + chunk_index) % y.n)) WHERE k <= 20),
{retrieval._FUSED[retrieval._FUSED.index("m AS (SELECT coalesce"):]},
ws AS (SELECT *, ({retrieval._STRETCH.format(c="semantic_similarity")}) * 0.55::DOUBLE + ({retrieval._STRETCH.format(c="keyword_score")}) * 0.35::DOUBLE + boost * 0.1::DOUBLE AS ws FROM b WINDOW w AS (PARTITION BY query_id)),
byscore AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ws, 12) DESC, filename, chunk_index, chunk_id)::INTEGER AS rank FROM ws)"""


def _chosen(ranking: str) -> str:
    """SQL of what is left of a ranking: no repeats, enough text, two of each document first, five in all; as final."""
    return f"""once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, CASE WHEN length(txt) >= 24 THEN txt[1:600] ELSE chunk_id::VARCHAR END ORDER BY rank) AS rep FROM {ranking} WHERE rank <= 15) WHERE rep = 1 AND length(txt) >= 24),
late AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) > 2 AS late FROM once),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank)::INTEGER AS final_rank FROM late)"""


def retrieve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job, in scope, by both lanes, fused by ranks."""
    return ranked_chunks(spark, sf_dir)[0].select("query_id", "chunk_id", "document_id", "final_rank", "retrieval_mode", "reason")


RETRIEVE_RANKED = f"""
WITH {_retrieved(False)}, {_chosen("fused")}, l AS (SELECT query_id, bool_or(keyword_score IS NOT NULL) AS k, bool_or(semantic_similarity IS NOT NULL) AS s FROM once GROUP BY query_id)
SELECT query_id, chunk_id, document_id, final_rank, retrieval_mode, CASE WHEN k AND s THEN 'hybrid_match' WHEN s THEN 'semantic_match' ELSE 'direct_keyword_match' END AS reason FROM final JOIN l USING (query_id) WHERE final_rank <= 5
"""


def retrieved_metrics(spark: SparkSession, sf_dir: str, mode: str = "rrf", k: int = 5) -> DataFrame:
    """V3 of retrieve()'s own ranking: against the chunks of ready documents that hold 0.7 of a question, 0.9 counting double."""
    p = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "passage_id")
    held = evaluate.passage_support(chunks(spark, sf_dir).where("document_id % 13 <> 0"), p, 0.7).withColumnRenamed("passage_id", "query_id")
    relevant = kept(held.select("query_id", "chunk_id", F.when(F.col("overlap") > 0.9, 2).otherwise(1).alias("grade")))  # read twice
    found = ranked_chunks(spark, sf_dir, mode)[0].where("reason <> 'broad_context_fallback'").select("query_id", "chunk_id", F.col("final_rank").alias("rank"))
    return evaluate.metrics(evaluate.grades(found, relevant), relevant, k)


def _retrieved_metrics(ranking: str, k: int, name: str) -> str:
    """SQL of retrieved_metrics() over a ranking, as name; after _retrieved() and _support."""
    return f"""{_chosen(ranking).replace("once", f"once_{name}").replace("late AS", f"late_{name} AS").replace("FROM late)", f"FROM late_{name})").replace("final AS", f"final_{name} AS")},
rk_{name} AS (SELECT query_id, chunk_id, final_rank AS rank FROM final_{name} WHERE final_rank <= {k}),
g_{name} AS (SELECT rk_{name}.*, coalesce(grade, 0) AS grade FROM rk_{name} LEFT JOIN rel USING (query_id, chunk_id)),
t_{name} AS (SELECT query_id, count(*) FILTER (grade > 0) AS f, min(rank) FILTER (grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS gain FROM g_{name} GROUP BY query_id),
{name} AS (SELECT query_id, coalesce((f > 0)::INTEGER::DOUBLE, 0) AS hit, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(f / n, 0) AS recall, coalesce(f / {k}, 0) AS precision, coalesce(gain / ideal, 0) AS ndcg FROM ideals LEFT JOIN t_{name} USING (query_id))"""


def _relevant(k: int) -> str:
    """SQL of the relevant chunks of ready documents, as rel and ideals."""
    return f"""{_SUPPORT[len(CHUNKS) + 2:]}, rel AS (SELECT passage_id AS query_id, chunk_id, CASE WHEN o > 0.9 THEN 2 ELSE 1 END AS grade FROM sup),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS r FROM rel), ideals AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= {k} THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS ideal FROM ir GROUP BY query_id)"""


def retrieve_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third question asks of two documents; what documents its answer has, and which are missing."""
    found, missing = ranked_chunks(spark, sf_dir, required=True)
    some = found.where("query_id % 3 = 0 and reason <> 'broad_context_fallback'").groupBy("query_id", "document_id").agg(F.count("*").alias("n"), F.min("final_rank").alias("first"))
    return some.unionByName(missing.select("query_id", "document_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("first")))


RETRIEVE_REQUIRED = f"""
WITH {_retrieved(True)}, {_chosen("fused")}, p AS (SELECT query_id, rank, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS place, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS of_document FROM once WHERE query_id IN (SELECT query_id FROM scoped WHERE few)),
d AS (SELECT query_id, count(DISTINCT document_id) AS n_docs, count(*) AS n_rows, max(place) FILTER (of_document = 1) AS second FROM p GROUP BY query_id),
c AS (SELECT p.query_id, p.document_id, CASE WHEN n_docs = 2 AND second > 5 AND place = second THEN 5 ELSE place END AS place FROM p JOIN d USING (query_id) WHERE CASE WHEN n_docs = 2 AND second > 5 THEN place <= 4 OR place = second ELSE place <= 5 END)
SELECT query_id, document_id, count(*) AS n, min(place)::INTEGER AS first FROM c GROUP BY ALL
UNION ALL SELECT query_id, x, 0, NULL FROM (SELECT query_id, unnest(list_distinct([a, b])) AS x, a <> b AS differ FROM scoped WHERE few) q WHERE differ AND NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = q.query_id AND c.document_id = q.x)
"""


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over the events at rest: windows of a day, every six hours."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = limits.sliding_counts(e, "1 day", "6 hours", 5)
    return w.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "n", "over_limit")


SLIDING_COUNTS = """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(6 * unnest(range(4))) AS s FROM events)
SELECT user_id, strftime(s, '%Y-%m-%d %H') AS window_start, count(*) AS n, count(*) > 5 AS over_limit FROM w GROUP BY user_id, s
"""


def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over the events at rest."""
    e = _events(spark, sf_dir).select("user_id", F.col("created_at").cast("timestamp").alias("ts"), "estimated_cost_usd")
    return limits.daily_spend(e).withColumn("spend_usd", F.round(F.col("spend_usd").cast("double"), 6))


DAILY_SPEND = f"WITH {_EVENTS} SELECT user_id, created_at::DATE AS day, count(*) AS n, round(sum(estimated_cost_usd::DECIMAL(18,8))::DOUBLE, 6) AS spend_usd FROM e GROUP BY ALL"


def inline_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 over answers: how many parts of each kind."""
    parts = _answers(spark, sf_dir).select("query_id", F.explode(t.inline_tokens(F.col("answer"))).alias("x"))
    return parts.groupBy("query_id", F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"))


INLINE_TOKENS = f"""
WITH {_ANSWERS}, c AS (SELECT query_id, len(regexp_extract_all(answer, '\\[\\[[sp]\\.\\d+\\]\\]')) AS n, len(list_filter(string_split(regexp_replace(answer, '\\[\\[[sp]\\.\\d+\\]\\]', chr(1), 'g'), chr(1)), lambda x: x <> '')) AS m FROM answers)
SELECT query_id, 'citation' AS kind, n FROM c WHERE n > 0 UNION ALL SELECT query_id, 'text', m FROM c WHERE m > 0
""".replace("\\\\", "\\")

QUERIES = {name: (globals()[name], globals().get(name.upper())) for name in (
    "pii_detect pii_mask pii_sequential pii_leaks luhn html_units file_kinds citations_validate citations_resolve claims risk_register obligations source_bundle risk_reports charts_parse evidence_gate prompt_chunks "
    "passage_support eval_metrics refusals ingest_job ingest_job_chunks ingest_kinds retrieve_job retrieve_ranked retrieve_required sliding_counts daily_spend inline_tokens"
).split()}
