"""Queries over readers, writers, scope, validation and parsers. What the given tables don't hold is made from them by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions import text as t
from ..operators import coverage, embed, markup, quality, reconcile, scope, sinks
from ..sources import io
from .common import CHUNKS, chunks, documents, spread, table, workspace
from .evidence import HTML_UNITS as _HTML_UNITS
from .operations import _STORED, _now, _stored


def _owner(name: str):
    return F.concat(F.lit("u"), (F.col(name) % 7).cast("string"))


def scope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each question may see: its collection's and its user's, of ready documents, with a vector; of three documents only where it names them."""
    d = documents(spark, sf_dir).select("document_id", "collection_id", "filename", _owner("document_id").alias("user_id"), F.lit("standard").alias("processing_mode"), F.when(F.col("document_id") % 10 == 0, "processing").otherwise("ready").alias("status"))
    c = chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("chunk_id") % 97 != 0, F.array(F.lit(1.0))))
    k = F.col("item_id") % 20
    named = F.when(F.col("item_id") % 3 == 0, F.array(k, k + 20, k + 40)).otherwise(F.array().cast("array<bigint>"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), k.cast("string")).alias("collection_id"), _owner("item_id").alias("user_id"), named.alias("document_ids"))
    return scope.searchable(c, d, q).groupBy("query_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


SCOPE_SEARCH = f"""
WITH {CHUNKS}, q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS collection_id, item_id % 7 AS owner, item_id % 3 = 0 AS few, item_id % 20 AS k FROM benchmark)
SELECT query_id, count(*) AS n, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM q JOIN chunks USING (collection_id)
WHERE document_id % 7 = owner AND document_id % 10 <> 0 AND chunk_id % 97 <> 0 AND (NOT few OR document_id IN (k, k + 20, k + 40)) GROUP BY query_id
"""


def attach_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of documents as candidates, with the masked text of private ones."""
    c = chunks(spark, sf_dir)
    masked = c.select("chunk_id", F.when(F.col("document_id") % 2 == 0, F.md5("content")).alias("provider_safe_content"))
    return scope.attach_projection(c.where("chunk_index = 0").select("chunk_id", "document_id"), masked)


ATTACH_PROJECTION = f"WITH {CHUNKS} SELECT chunk_id, document_id, CASE WHEN document_id % 2 = 0 THEN md5(content) END AS provider_safe_content FROM chunks WHERE chunk_index = 0"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made safe and shown, and paths taken apart."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("Dir/Été  "), "p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")!.PDF"))
    path = F.concat(F.lit("u"), (F.col("p_partkey") % 5).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("/c")).otherwise(F.lit("/c/d")), F.lit("/"), F.col("p_partkey").cast("string"))
    named = p.select("p_partkey", name.alias("name"), path.alias("path"))
    parsed = files.parse_path(F.col("path"))
    return named.select(
        "p_partkey", files.safe_filename(F.col("name")).alias("safe"), files.display_filename(F.col("name")).alias("shown"), t.slugify(F.col("name")).alias("slug"),
        parsed["user_id"].alias("user_id"), parsed["name"].alias("last"), files.owned_by(F.col("path"), F.lit("u1")).alias("owned"),
    )


FILE_NAMES = r"""
WITH n AS (SELECT p_partkey, 'Été  ' || p_name || ' (' || p_partkey || ')!.PDF' AS name, 'u' || (p_partkey % 5) AS u, p_partkey % 3 <> 0 AS whole FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS safe, regexp_replace(name, '\s+', ' ', 'g') AS shown,
  trim(regexp_replace(lower(strip_accents('dir ' || name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN whole THEN u END AS user_id, CASE WHEN whole THEN p_partkey::VARCHAR END AS last, u = 'u1' AS owned FROM n
"""


def extraction_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 with limits that some documents pass."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("page_count"), F.length("text").alias("char_count"), t.count_words(F.col("text")).alias("n_units"))
    return quality.extraction_limits(d, 45, 5000, 300).select("doc_id", "violation")


EXTRACTION_LIMITS = r"""
SELECT doc_id, CASE WHEN doc_id % 50 > 45 THEN 'too_many_pages' WHEN length(text) > 5000 THEN 'too_many_characters' WHEN len(list_filter(string_split_regex(text, '[\s\x{00A0}\x{FEFF}]+'), lambda w: w <> '')) > 300 THEN 'too_many_units' END AS violation FROM documents
"""


def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, cut short by arithmetic and with markup put in: enough text, qualifying, executable."""
    cut = F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 18)).otherwise(F.col("text"))
    tail = F.when(F.col("turn") % 4 == 1, F.lit(" <img onload = x>")).when(F.col("turn") % 4 == 2, F.lit(" < SCRIPT >")).otherwise(F.lit(""))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(cut, tail).alias("text"), F.when(F.col("turn") % 2 == 0, "pdf").otherwise("text").alias("kind"))
    out = quality.min_content(c)
    score, similarity = F.col("turn") % 3, F.when(F.col("conv_id") % 2 == 0, F.lit(0.6))
    return out.select(
        "conv_id", "turn", "too_short", coverage.is_meaningful(F.col("text")).alias("meaningful"),
        coverage.is_qualifying(F.col("text"), score.cast("double"), similarity).alias("qualifying"), t.has_executable_markup(F.col("text")).alias("executable"),
    )


READABLE = r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text[1:18] ELSE text END || CASE turn % 4 WHEN 1 THEN ' <img onload = x>' WHEN 2 THEN ' < SCRIPT >' ELSE '' END AS text, turn % 2 = 0 AS pdf FROM conversations),
n AS (SELECT *, length(trim(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS n, length(trim(text, ' ')) AS l, len(list_filter(string_split_regex(text, '[\s\x{00A0}\x{FEFF}]+'), lambda w: w <> '')) AS w FROM c)
SELECT conv_id, turn, CASE WHEN pdf THEN l < 20 OR w < 5 ELSE l < 10 OR w < 2 END AS too_short, n >= 24 AS meaningful, n >= 40 AND (turn % 3 > 0 OR conv_id % 2 = 0) AS qualifying, turn % 4 IN (1, 2) AS executable FROM n
"""


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents whose first bytes deny their names, and such as aren't text."""
    head = F.element_at(F.array(F.lit("%PDF"), F.lit("PK\x03\x04"), F.lit("text"), F.lit("\x01\x02\x03\x04\x05")), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("a"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".txt", ".docx", ".csv", ".none")]), (F.col("p_partkey") % 5 + 1).cast("int")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(head, "p_name").cast("binary").alias("content"), name.alias("name"))
    return p.select("p_partkey", files.content_mismatch(F.col("content"), F.col("name")).alias("mismatch"), files.looks_binary(F.col("content")).alias("looks_binary"))


SNIFFED = """
WITH p AS (SELECT p_partkey, p_partkey % 4 AS h, ['pdf', 'txt', 'docx', 'csv', 'none'][p_partkey % 5 + 1] AS e, length(p_name) AS n FROM part)
SELECT p_partkey, CASE e WHEN 'pdf' THEN h <> 0 WHEN 'docx' THEN h <> 1 WHEN 'none' THEN false ELSE h IN (0, 1) END AS mismatch, CASE h WHEN 1 THEN 2.0 / (n + 4) >= 0.02 WHEN 3 THEN 5.0 / (n + 5) >= 0.02 ELSE false END AS looks_binary FROM p
"""


def html_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as bytes of Latin-1 that say so; their units are those of the pages."""
    said = table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(F.lit('<meta charset="iso-8859-1">'), "html"), "ISO-8859-1").alias("content"))
    u = markup.from_html_bytes(said, ["page_id"])
    return u.select("page_id", "unit_index", "block_type", F.md5("text").alias("text_md5"), F.size("heading_path").alias("depth"))


HTML_CHARSET = _HTML_UNITS


def _markdown():
    """A page of Markdown about each part."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    lines = (
        F.lit("# "), "p_brand", F.lit("\n\n**"), "p_name", F.lit("**\nsecond [line](http://x)\n\nSize\n---\n- "), size, F.lit("\n2. "), size, F.lit("\n> "), "p_type",
        F.lit("\n\n| key | size |\n| --- | ---: |\n| "), key, F.lit(" | "), size, F.lit(" |\n\n```sql\nselect "), key, F.lit("\n```\n"),
    )
    return F.concat(*[x if not isinstance(x, str) else F.col(x) for x in lines])


def markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    own = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"))
    u = markup.from_markdown(own.select("p_partkey", _markdown().alias("text")), ["p_partkey"])
    return u.select("p_partkey", "unit_index", "block_type", "text", F.array_join("heading_path", " > ").alias("headings"), "source_location", "code_language", "table_context")


MARKDOWN_UNITS = """
WITH u AS (SELECT p_partkey, p_brand AS b, unnest([{'k': 'heading', 't': p_brand, 'l': 1}, {'k': 'paragraph', 't': p_name || ' second line', 'l': 3}, {'k': 'heading', 't': 'Size', 'l': 6}, {'k': 'list_item', 't': p_size::VARCHAR, 'l': 8}, {'k': 'list_item', 't': p_size::VARCHAR, 'l': 9},
  {'k': 'quote', 't': p_type, 'l': 10}, {'k': 'table_row', 't': 'key: ' || p_partkey || '; size: ' || p_size, 'l': 14}, {'k': 'code', 't': 'select ' || p_partkey, 'l': 16}]) AS x, unnest(range(8))::INTEGER AS unit_index FROM part)
SELECT p_partkey, unit_index, x.k AS block_type, x.t AS text, CASE WHEN unit_index < 2 THEN b ELSE b || ' > Size' END AS headings, 'line ' || x.l AS source_location, CASE WHEN unit_index = 7 THEN 'sql' END AS code_language, CASE WHEN unit_index = 6 THEN 'key | size' END AS table_context FROM u
"""


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines written as CSV with quotes, line ends in cells and blank rows, and read again."""
    cell = F.concat(F.lit('  "'), "l_returnflag", F.lit(', ""'), "l_linestatus", F.lit('""\nx" '))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(","), cell, F.lit(", "), F.col("l_partkey").cast("string"), F.lit("\r\n\r\n"))
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))))
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("﻿n,c,p\n"), F.array_join(F.transform(own, lambda x: x["line"]), "")).alias("text"))
    return markup.parse_csv(text, ["l_orderkey"]).select("l_orderkey", "row_index", F.array_join("cells", "|").alias("cells"))


CSV_ROWS = """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS row_index, l_linenumber || '|' || l_returnflag || ', "' || l_linestatus || '"' || chr(10) || 'x|' || l_partkey AS cells FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 0, 'n|c|p' FROM lineitem
"""


def extract_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by kind, one kind by an extractor of the caller's own."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("html"), F.lit("markdown"), F.lit("shout"), F.lit("pdf")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<p>"), "p_name", F.lit("<p>end"))).otherwise(F.concat(F.col("p_name"), F.lit("\n\nend")))
    shout = lambda docs, keys, column: docs.select(*keys, F.lit(0).alias("unit_index"), F.lit("shout").alias("block_type"), F.upper(column).alias("text"))
    u = markup.extract(p.select("p_partkey", kind.alias("kind"), text.alias("text")), ["p_partkey"], extractors=markup.EXTRACTORS | {"shout": shout})
    return u.select("p_partkey", "unit_index", "block_type", "text")


EXTRACT_KINDS = """
SELECT p_partkey, 0 AS unit_index, CASE WHEN p_partkey % 4 = 2 THEN 'shout' ELSE 'paragraph' END AS block_type, CASE WHEN p_partkey % 4 = 2 THEN upper(p_name) || chr(10) || chr(10) || 'END' ELSE p_name END AS text FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, 1, 'paragraph', 'end' FROM part WHERE p_partkey % 4 < 2
"""


def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a snapshot written and read again by its schemas: rows of each table and the sum of their sizes."""
    s, folder = _stored(spark, sf_dir), workspace(spark)
    for name, schema in io.SNAPSHOT.items():
        own = s["chunks"].where("not has_embedding").withColumn("chunk_id", F.col("document_id").cast("string")) if name == "null_embeddings" else s[name]
        fields = [x.split() for x in schema.split(", ")]
        own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields]).write.parquet(f"{folder}/{name}")
    read = io.read_snapshot(spark, folder)
    sizes = {"objects": "size", "documents": "file_size"}
    out = None
    for name, df in read.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), (F.sum(sizes[name]) if name in sizes else F.lit(0)).cast("long").alias("bytes"))
        out = row if out is None else out.unionByName(row)
    return out


SNAPSHOT_TABLES = f"""
WITH {_STORED} SELECT 'objects' AS name, count(*) AS n, sum(size)::BIGINT AS bytes FROM objs UNION ALL SELECT 'documents', count(*), sum(file_size)::BIGINT FROM docs UNION ALL SELECT 'collections', count(*), 0 FROM cols
UNION ALL SELECT 'chunks', count(*), 0 FROM cks UNION ALL SELECT 'null_embeddings', count(*), 0 FROM cks WHERE NOT has_embedding
"""


def _filed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the turns of conversations as text files, conversation by conversation, of four kinds of names."""
    folder = f"{workspace(spark)}/files"
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id") % 8).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.length("text").cast("string")))), "\n").alias("markdown")).toDF("k", "markdown")
    sinks.write_markdown(c, folder, "k")
    return folder


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as a text file for each of eight keys, listed with their sizes and read again."""
    folder = _filed(spark, sf_dir)
    key = F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long")
    listed = io.list_objects(spark, folder).where("size > 0 and path like '%.txt'").select(key.alias("k"), "size")
    read = io.read_documents(spark, folder).where("kind = 'text'").select(key.alias("k"), F.md5(F.rtrim(F.regexp_replace("text", r"\n+$", ""))).alias("text_md5"))
    return listed.join(read, "k")


STORED_FILES = """
WITH l AS (SELECT conv_id % 8 AS k, lpad(conv_id::VARCHAR, 9, '0') || ':' || lpad(turn::VARCHAR, 6, '0') || ':' || length(text) AS x FROM conversations), s AS (SELECT k, string_agg(x, chr(10) ORDER BY x) AS t FROM l GROUP BY k)
SELECT k, strlen(t) + 1 AS size, md5(t) AS text_md5 FROM s
"""


def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the benchmark as a nested golden set, a line of JSON for each item, written and read: what supports each case."""
    b, folder = table(spark, sf_dir, "benchmark"), f"{workspace(spark)}/golden"
    key = F.col("item_id").cast("string")
    doc = F.struct(F.concat(F.lit("d"), key).alias("id"), F.concat(key, F.lit(".txt")).alias("filename"), F.lit("txt").alias("format"), F.array(F.struct(F.lit("p1").alias("id"), F.substring("text", 1, 40).alias("text")), F.struct(F.lit("p2").alias("id"), F.substring("text", 41, 40).alias("text"))).alias("passages"))
    case = F.struct(
        F.concat(F.lit("c"), key).alias("id"), F.when(F.col("item_id") % 3 == 0, "holdout").otherwise("development").alias("split"), F.lit("lookup").alias("category"), F.col("text").alias("question"), F.lit(True).alias("answerable"),
        F.array(F.concat(F.lit("d"), key)).alias("requiredDocumentIds"), F.array(F.struct(F.concat(F.lit("d"), key).alias("documentId"), F.when(F.col("item_id") % 2 == 0, "p1").otherwise("p2").alias("passageId"), F.lit(2).alias("grade"))).alias("support"),
    )
    b.select(F.array(doc).alias("documents"), F.array(case).alias("cases")).write.json(folder)
    g = io.read_golden(spark, folder, multi_line=False)
    held = g["support"].join(g["passages"], ["document_id", "passage_id"]).join(g["cases"].select("case_id", "split"), "case_id").join(g["documents"], "document_id")
    return held.select("case_id", "split", "document_id", "filename", "processing_mode", "passage_id", "grade", F.md5("text").alias("text_md5"))


GOLDEN_SET = """
SELECT 'c' || item_id AS case_id, CASE WHEN item_id % 3 = 0 THEN 'holdout' ELSE 'development' END AS split, 'd' || item_id AS document_id, item_id || '.txt' AS filename, 'standard' AS processing_mode, CASE WHEN item_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS passage_id, 2 AS grade,
  md5(CASE WHEN item_id % 2 = 0 THEN text[1:40] ELSE text[41:80] END) AS text_md5 FROM benchmark
"""


def manifest_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of orphans written and read."""
    s, folder = _stored(spark, sf_dir), f"{workspace(spark)}/manifest"
    sinks.write_manifest(reconcile.build_manifest(s["objects"], s["documents"], _now()), folder)
    return io.read_manifest(spark, folder).select("candidate_id", "path", F.col("first_witness.size").alias("size"), F.col("second_witness").isNull().alias("seen_once"))


MANIFEST_AGAIN = f"WITH {_STORED} SELECT 'cand_' || sha256('project:documents:' || path)[1:24] AS candidate_id, path, size, true AS seen_once FROM objs WHERE path NOT IN (SELECT storage_path FROM docs)"


def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest chunks without a vector."""
    c = chunks(spark, sf_dir).select("chunk_id", (F.col("document_id") % 50).alias("created_at"), F.when(F.col("chunk_id") % 3 != 0, F.lit(1)).alias("embedding"))
    return embed.backlog(c, 100).select("chunk_id", "created_at")


EMBEDDING_BACKLOG = f"WITH {CHUNKS} SELECT chunk_id, document_id % 50 AS created_at FROM chunks WHERE chunk_id % 3 = 0 ORDER BY created_at, chunk_id LIMIT 100"


def model_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report on documents and chunks, some broken by arithmetic."""
    d = _stored(spark, sf_dir)["documents"].join(documents(spark, sf_dir).select("document_id", "filename"), "document_id")
    mode = F.when(F.col("document_id") % 2 == 0, "privacy_minimised").otherwise("standard")
    d = d.withColumn("status", F.when(F.col("document_id") % 41 == 0, "odd").otherwise(F.col("status"))).withColumn("processing_mode", mode).withColumn("filename", F.when(F.col("document_id") % 43 == 0, " ").otherwise(F.col("filename")))
    private = F.col("document_id") % 2 == 0
    c = chunks(spark, sf_dir).select(
        F.when(F.col("document_id") % 47 == 0, -1).otherwise(F.col("document_id")).alias("document_id"), "chunk_index", (F.col("chunk_id") % 5).alias("page_number"), F.when(F.col("chunk_id") % 59 == 0, "").otherwise(F.col("content")).alias("content"),
        F.when(private, "m").alias("provider_safe_content"), F.when(private & (F.col("chunk_id") % 7 != 0), "1").alias("privacy_policy_version"), F.when(private, "privacy_minimised").otherwise("original").alias("embedding_projection"),
    )
    return quality.check_constraints(d, c)


MODEL_CONSTRAINTS = f"""
WITH {_STORED}, ck AS (SELECT CASE WHEN document_id % 47 = 0 THEN -1 ELSE document_id END AS document_id, document_id AS own, chunk_index, chunk_id FROM chunks)
SELECT 'documents' AS "table", 'status known' AS rule, count(*) FILTER (document_id % 41 = 0) AS violations FROM docs UNION ALL SELECT 'documents', 'mode known', 0 UNION ALL SELECT 'documents', 'file name not blank', count(*) FILTER (document_id % 43 = 0) FROM docs UNION ALL SELECT 'documents', 'file size', 0
UNION ALL SELECT 'documents', 'unique(storage_path)', count(*) - count(DISTINCT storage_path) FROM docs UNION ALL SELECT 'document_chunks', 'page number', count(*) FILTER (chunk_id % 5 < 1) FROM ck UNION ALL SELECT 'document_chunks', 'chunk index', 0
UNION ALL SELECT 'document_chunks', 'content not blank', count(*) FILTER (chunk_id % 59 = 0) FROM ck UNION ALL SELECT 'document_chunks', 'unique(document_id, chunk_index)', (SELECT count(*) FROM ck) - (SELECT count(*) FROM (SELECT DISTINCT document_id, chunk_index FROM ck))
UNION ALL SELECT 'document_chunks', 'document_id -> document_id', count(*) FILTER (document_id = -1) FROM ck UNION ALL SELECT 'document_chunks', 'privacy projection', count(*) FILTER (document_id >= 0 AND own % 2 = 0 AND chunk_id % 7 = 0) FROM ck
"""


QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "scope_search attach_projection file_names extraction_limits readable sniffed html_charset markdown_units csv_rows extract_kinds snapshot_tables stored_files golden_set manifest_again embedding_backlog model_constraints"
).split()}
