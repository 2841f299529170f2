"""Queries over usage, lifecycles, storage and the tables' integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, inventory, lifecycle, quality, reconcile, sinks, stats, usage
from .common import CHUNKS, chunks, documents, table

NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "failed").otherwise("success").alias("status"),
        F.when(F.col("event_type") == "signup", "document_inventory").otherwise(F.concat(F.lit("model-"), (k % 3).cast("string"))).alias("model"),
        (F.col("value") / 1000).alias("estimated_cost_usd"),
        (k * 10).alias("input_tokens"),
        (k * 2).alias("output_tokens"),
    )


_EVENTS = """e AS (SELECT event_id, user_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_type = 'signup' THEN 'document_inventory' ELSE 'model-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) END AS model, value / 1000 AS estimated_cost_usd,
  CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS input_tokens, CAST(json_extract_string(props, '$.k') AS INTEGER) * 2 AS output_tokens FROM events),
c AS (SELECT * FROM e WHERE status <> 'blocked' AND model <> 'document_inventory')"""


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 as of noon on 15 January."""
    s = usage.summarize(_events(spark, sf_dir), _now())
    return s.withColumn("daily_spend_usd", F.round(F.col("daily_spend_usd").cast("double"), 6))


USAGE_SUMMARY = f"""
WITH {_EVENTS} SELECT user_id, count(*) AS daily_requests, round(sum(estimated_cost_usd::DECIMAL(18,8))::DOUBLE, 6) AS daily_spend_usd, count(*) FILTER (created_at >= {NOW} - INTERVAL 60 SECOND) AS minute_requests,
  min(created_at) FILTER (created_at >= {NOW} - INTERVAL 60 SECOND) AS oldest_minute_at FROM c WHERE created_at >= date_trunc('day', {NOW}) AND created_at <= {NOW} GROUP BY user_id
"""


def usage_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10 as of each event."""
    return usage.rolling(_events(spark, sf_dir)).withColumn("daily_spend_usd", F.round(F.col("daily_spend_usd").cast("double"), 6))


USAGE_ROLLING = f"""
WITH {_EVENTS} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS minute_requests,
  count(*) OVER d AS daily_requests, round((sum(estimated_cost_usd::DECIMAL(18,8)) OVER d)::DOUBLE, 6) AS daily_spend_usd FROM c
WINDOW d AS (PARTITION BY user_id, created_at::DATE ORDER BY created_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("model-0", 0.1, 0.5), ("model-1", -1.0, 2.0)], "model string, input_usd double, output_usd double")


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model has a price, one a wrong one, others none."""
    return usage.cost(_events(spark, sf_dir), _prices(spark)).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


USAGE_COST = f"""
WITH {_EVENTS} SELECT event_id, model, round((input_tokens * CASE model WHEN 'model-0' THEN 0.1::DOUBLE ELSE 3 END + output_tokens * CASE model WHEN 'model-0' THEN 0.5::DOUBLE ELSE 15 END) / 1000000, 9) AS cost_usd FROM e
"""


def budget_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of each user at noon on 15 January."""
    events = _events(spark, sf_dir)
    asked = events.groupBy("user_id").agg((F.max("input_tokens") * 7).alias("input_tokens")).withColumn("cost_usd", F.lit(0.002))
    return usage.decide(asked, usage.summarize(events, _now()), _now(), per_minute=1, per_day=2, budget_inr=1.0)


BUDGET_DECISION = f"""
WITH {_EVENTS}, s AS (SELECT user_id, count(*) AS n, sum(estimated_cost_usd::DECIMAL(18,8))::DOUBLE AS spend, count(*) FILTER (created_at >= {NOW} - INTERVAL 60 SECOND) AS m, min(created_at) FILTER (created_at >= {NOW} - INTERVAL 60 SECOND) AS o
  FROM c WHERE created_at >= date_trunc('day', {NOW}) AND created_at <= {NOW} GROUP BY user_id),
a AS (SELECT user_id, max(input_tokens) * 7 AS input_tokens, 0.002::DOUBLE AS cost_usd FROM e GROUP BY user_id),
r AS (SELECT a.*, o, CASE WHEN input_tokens > 6000 THEN 'prompt_too_large' WHEN coalesce(m, 0) >= 1 THEN 'minute_rate_limit' WHEN coalesce(n, 0) >= 2 THEN 'daily_request_limit' WHEN (coalesce(spend, 0) + cost_usd) * 85 > 1 THEN 'daily_budget_limit' ELSE 'allowed' END AS reason FROM a LEFT JOIN s USING (user_id))
SELECT user_id, input_tokens, cost_usd, CASE WHEN reason = 'allowed' THEN 'allowed' ELSE 'blocked' END AS status, reason,
  CASE WHEN reason = 'minute_rate_limit' THEN greatest(1, ceil((epoch_us(o) + 60000000 - epoch_us({NOW})) / 1000000))::INTEGER WHEN reason IN ('daily_request_limit', 'daily_budget_limit') THEN 43200 END AS retry_after_s FROM r
"""


def strict_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values, where values of 1 or less are unknown."""
    e = table(spark, sf_dir, "events").withColumn("known", F.when(F.col("value") > 1, F.round(F.col("value") * 100).cast("long")))
    return usage.strict_sum(e, ["user_id"], "known")


STRICT_SUMS = "SELECT user_id, CASE WHEN count(*) FILTER (value > 1) = count(*) THEN sum(round(value * 100)::BIGINT)::BIGINT END AS total FROM events GROUP BY user_id"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for each message of a user."""
    m = table(spark, sf_dir, "conversations").where("role = 'user'")
    return m.select("conv_id", "turn", usage.route_model(F.concat("text", F.when(F.col("conv_id") % 4 == 0, F.lit(" Compare them.")).otherwise(F.lit(""))), F.col("turn")).alias("r")).select("conv_id", "turn", "r.*")


ROUTES = """
WITH m AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 4 = 0 THEN ' Compare them.' ELSE '' END AS t FROM conversations WHERE role = 'user'),
r AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)\\b(compare|contrast|analy[sz]e|evaluate|risks?|conflicts?|inconsisten\\w*|legal|contract\\w*|obligations?|synthesi[sz]e|reconcile|why)\\b') THEN 'question_pattern' WHEN turn >= 8 THEN 'many_chunks' WHEN length(t) > 900 THEN 'long_question' ELSE 'default' END AS reason FROM m)
SELECT conv_id, turn, CASE WHEN reason = 'default' THEN 'fast' ELSE 'strong' END AS model, reason FROM r
""".replace("\\\\", "\\")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16 by type of event."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.get_json_object("props", "$.k").cast("int") % 10 != 0)
    return stats.latency(e, ["event_type"], "value", "ok").withColumn("error_rate", F.round("error_rate", 6))


LATENCY_PERCENTILES = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 AS bad FROM events)
SELECT event_type, max(n) AS n, count(*) FILTER (bad) AS errors, min(value) FILTER (k >= ceil(n * 0.5::DOUBLE)) AS p50, min(value) FILTER (k >= ceil(n * 0.95::DOUBLE)) AS p95, min(value) FILTER (k >= ceil(n * 0.99::DOUBLE)) AS p99, round(count(*) FILTER (bad) / max(n), 6) AS error_rate FROM r GROUP BY event_type
"""


def pair_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16."""
    p = chat.pair_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return p.select("conv_id", "question_at", "answer_at", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


_PAIRS = """p AS (SELECT conv_id, lag(turn) OVER w AS question_at, turn AS answer_at, lag(text) OVER w AS question, text AS answer, role, lag(role) OVER w AS r FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT * FROM p WHERE role = 'assistant' AND r = 'user')"""
PAIR_MESSAGES = f"WITH {_PAIRS} SELECT conv_id, question_at, answer_at, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM pairs"


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of each conversation."""
    return chat.recent(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role", "truncated")


RECENT_MESSAGES = """
SELECT conv_id, turn, role, n > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k <= 3
"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    return chat.transcript(chat.pair_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn"), ["conv_id"])


TRANSCRIPT = f"""
WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY answer_at) AS k FROM pairs)
SELECT conv_id, '# Conversation' || chr(10) || chr(10) || string_agg('## Question ' || k || chr(10) || chr(10) || question || chr(10) || chr(10) || '### Answer' || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY k) AS markdown FROM n GROUP BY conv_id
"""


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A snapshot by arithmetic: paths owner/collection/document/name of plain ids; some objects and documents astray."""
    d = table(spark, sf_dir, "documents")
    owner = F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string"))
    own = F.concat(owner, F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"))
    shared = F.concat(F.lit("u0/shared/d"), F.expr("doc_id div 26").cast("string"))  # two documents refer to each of these
    path = F.concat(F.when(F.col("doc_id") % 13 == 0, shared).otherwise(own), F.lit("/text.txt"))
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, CAST(doc_id % 20000 AS INT))")
    docs = d.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), path.alias("storage_path"), F.col("n_chars").alias("file_size"),
        F.when(F.col("doc_id") % 9 == 0, "failed").when(F.col("doc_id") % 10 == 0, "processing").when(F.col("doc_id") % 21 == 0, "awaiting_upload").otherwise("ready").alias("status"),
        F.when(F.col("doc_id") % 9 == 0, "failed").when(F.col("doc_id") % 10 == 0, "chunking").otherwise("done").alias("processing_stage"),
        start.alias("created_at"), F.when(F.col("doc_id") % 4 == 0, start).alias("processing_started_at"), F.when(F.col("doc_id") % 3 == 0, start).alias("processing_stage_updated_at"),
        F.when(F.col("doc_id") % 18 == 0, start).alias("upload_expired_at"),
    )
    objects = d.where("doc_id % 7 <> 0").select(F.concat(owner, F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/text.txt")).alias("path"), F.col("n_chars").alias("size"), start.alias("created_at"), start.alias("updated_at"), owner.alias("owner_id"))
    lost = d.where("doc_id % 11 = 0").select(F.concat(F.lit("lost/"), F.col("doc_id").cast("string")).alias("path"), F.lit(5).cast("long").alias("size"), start.alias("created_at"), start.alias("updated_at"), F.lit("lost").alias("owner_id"))
    cut = chunks(spark, sf_dir).select("document_id", "chunk_index", (F.col("chunk_id") % 97 != 0).alias("has_embedding")).where("not (document_id % 31 = 0 and chunk_index = 0)")
    return {"documents": docs, "objects": objects.unionByName(lost), "collections": d.select(F.col("source").alias("collection_id")).distinct().where("collection_id <> 'src3'"), "chunks": cut}


IDENTIFIER = "[a-z]+[0-9]+"
_AT = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 20000))"
_STORED = f"""{CHUNKS},
docs AS (SELECT doc_id AS document_id, source AS collection_id, CASE WHEN doc_id % 13 = 0 THEN 'u0/shared/d' || (doc_id // 26) ELSE 'u' || (doc_id % 7) || '/' || source || '/d' || doc_id END || '/text.txt' AS storage_path, n_chars AS file_size,
  CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 10 = 0 THEN 'processing' WHEN doc_id % 21 = 0 THEN 'awaiting_upload' ELSE 'ready' END AS status,
  CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 10 = 0 THEN 'chunking' ELSE 'done' END AS processing_stage, {_AT} AS created_at, CASE WHEN doc_id % 4 = 0 THEN {_AT} END AS processing_started_at,
  CASE WHEN doc_id % 3 = 0 THEN {_AT} END AS processing_stage_updated_at, CASE WHEN doc_id % 18 = 0 THEN {_AT} END AS upload_expired_at FROM documents),
objs AS (SELECT 'u' || (doc_id % 7) || '/' || source || '/d' || doc_id || '/text.txt' AS path, n_chars AS size, {_AT} AS created_at, 'u' || (doc_id % 7) AS owner_id FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'lost/' || doc_id, 5, {_AT}, 'lost' FROM documents WHERE doc_id % 11 = 0),
cols AS (SELECT DISTINCT source AS collection_id FROM documents WHERE source <> 'src3'),
cks AS (SELECT document_id, chunk_index, chunk_id % 97 <> 0 AS has_embedding FROM chunks WHERE NOT (document_id % 31 = 0 AND chunk_index = 0)),
incomplete AS (SELECT d.* FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n, max(chunk_index) AS m, min(chunk_index) AS l, bool_and(has_embedding) AS a FROM cks GROUP BY document_id) c USING (document_id) WHERE status = 'ready' AND NOT coalesce(l = 0 AND m = n - 1 AND a, false)),
dup AS (SELECT storage_path, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM docs GROUP BY storage_path HAVING count(*) > 1)"""


def classify_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    s = _stored(spark, sf_dir)
    return reconcile.classify(s["objects"], s["documents"], s["collections"], s["chunks"], _now(), IDENTIFIER)


_ONE = "SELECT '{}' AS class, count(*) AS count, coalesce(sum({}), 0)::BIGINT AS bytes FROM {}"
CLASSIFY_STORAGE = f"WITH {_STORED} " + " UNION ALL ".join(
    [
        _ONE.format("STORAGE_ORPHAN", "size", "objs WHERE path NOT IN (SELECT storage_path FROM docs)"),
        _ONE.format("UNEXPECTED_OBJECT", "size", "objs WHERE path LIKE 'lost/%'"),
        _ONE.format("MISSING_OBJECT", "file_size", "docs WHERE storage_path NOT IN (SELECT path FROM objs)"),
        _ONE.format("COLLECTION_ORPHAN", "file_size", "docs WHERE collection_id NOT IN (SELECT collection_id FROM cols)"),
        _ONE.format("STALE_PROCESSING", "file_size", f"docs WHERE (status = 'processing' OR processing_stage = 'chunking') AND coalesce(processing_started_at, created_at) < {NOW} - INTERVAL 15 MINUTE"),
        _ONE.format("FAILED_WITH_OBJECT", "file_size", "docs JOIN objs ON storage_path = path WHERE status = 'failed'"),
        _ONE.format("READY_WITHOUT_COMPLETE_CHUNKS", "file_size", "incomplete"),
        _ONE.format("CHUNK_ORPHAN", "0", "cks WHERE document_id NOT IN (SELECT document_id FROM docs)"),
        _ONE.format("DUPLICATE_REFERENCE", "file_size", "docs WHERE storage_path IN (SELECT storage_path FROM dup)"),
    ]
)


def incomplete_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    s = _stored(spark, sf_dir)
    return reconcile.incomplete_ready(s["documents"], s["chunks"]).select("document_id", "collection_id")


INCOMPLETE_READY = f"WITH {_STORED} SELECT document_id, collection_id FROM incomplete"


def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return reconcile.duplicate_references(_stored(spark, sf_dir)["documents"])


DUPLICATE_PATHS = f"WITH {_STORED} SELECT storage_path, n, bytes FROM dup"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inventories ten days apart; between them objects of ids divisible by 5 changed and lost ones above 500 went."""
    s = _stored(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)(?:/text.txt)?$", 1).cast("long")
    later = s["objects"].where(~(F.col("path").startswith("lost/") & (number > 500))).withColumn("size", F.when(number % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    first = reconcile.build_manifest(s["objects"], s["documents"], F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"))
    return reconcile.build_manifest(later, s["documents"], F.expr("TIMESTAMP_NTZ '2024-01-25 12:00:00'"), first)


_MANIFEST = f"""{_STORED},
orphans AS (SELECT *, regexp_extract(path, '(\\d+)(?:/text.txt)?$', 1)::BIGINT AS k FROM objs WHERE path NOT IN (SELECT storage_path FROM docs)),
m AS (SELECT 'cand_' || sha256('project:documents:' || path)[1:24] AS candidate_id, path, owner_id, size, created_at, NOT (path LIKE 'lost/%' AND k > 500) AS there, k % 5 = 0 AS changed FROM orphans)""".replace("\\\\", "\\")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return _manifest(spark, sf_dir).select("candidate_id", "path", F.col("first_witness.size").alias("first_size"), F.col("second_witness.object_exists").alias("still_there"), F.col("second_witness.size").alias("second_size"))


MANIFEST = f"WITH {_MANIFEST} SELECT candidate_id, path, size AS first_size, there AS still_there, CASE WHEN there THEN size + CASE WHEN changed THEN 1 ELSE 0 END END AS second_size FROM m"


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, ten days on."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-25 12:00:00'")
    return reconcile.eligibility(_manifest(spark, sf_dir), at, identifier=IDENTIFIER).select("path", F.array_join("reasons", ",").alias("reasons"), "state")


_REASONS = """concat_ws(',', CASE WHEN path LIKE 'lost/%' THEN 'PATH_PREFIX_OR_DEPTH' END, CASE WHEN NOT there THEN 'SECOND_WITNESS_INVALID' END, CASE WHEN NOT there OR changed THEN 'OBJECT_METADATA_CHANGED' END,
  CASE WHEN created_at > TIMESTAMP '2024-01-25 12:00:00' OR epoch_us(TIMESTAMP '2024-01-25 12:00:00') - epoch_us(created_at) < 7 * 86400000000 THEN 'AGE_UNDER_GRACE_PERIOD' END)"""
ELIGIBILITY = f"WITH {_MANIFEST}, r AS (SELECT *, {_REASONS} AS reasons FROM m) SELECT path, reasons, CASE WHEN reasons = '' THEN 'eligible' ELSE 'ineligible' END AS state FROM r"


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run against the first inventory's objects."""
    s = _stored(spark, sf_dir)
    at = F.expr("TIMESTAMP_NTZ '2024-01-25 12:00:00'")
    return reconcile.plan(_manifest(spark, sf_dir), s["objects"], s["documents"], at, identifier=IDENTIFIER).select("path", F.array_join("reasons", ",").alias("reasons"), "state", "refusal")


CLEANUP_PLAN = f"""
WITH {_MANIFEST}, r AS (SELECT *, {_REASONS} AS reasons FROM m), n AS (SELECT count(*) AS n FROM r WHERE reasons = '')
SELECT path, reasons, CASE WHEN reasons = '' THEN 'eligible' ELSE 'ineligible' END AS state, CASE WHEN n > 5 THEN 'MAX_DELETE_EXCEEDED' END AS refusal FROM r, n
"""


def lifecycle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return lifecycle.sweep(_stored(spark, sf_dir)["documents"], _now()).where("action is not null").select("document_id", "action", "next_status", "message")


LIFECYCLE_SWEEP = f"""
WITH {_STORED}, a AS (SELECT *, CASE WHEN status = 'awaiting_upload' AND created_at < {NOW} - INTERVAL 60 MINUTE THEN 'expire_upload' WHEN status = 'processing' AND coalesce(processing_stage_updated_at, created_at) < {NOW} - INTERVAL 6 MINUTE THEN 'fail_stalled'
  WHEN status = 'failed' AND upload_expired_at IS NOT NULL AND created_at < {NOW} - INTERVAL 125 MINUTE THEN 'remove_late_object' END AS action FROM docs)
SELECT document_id, action, 'failed' AS next_status, CASE action WHEN 'expire_upload' THEN '{lifecycle.EXPIRED}' WHEN 'fail_stalled' THEN replace(processing_stage, '_', ' ') || ': Processing stopped making progress. Retry to try again.' END AS message FROM a WHERE action IS NOT NULL
"""


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    return lifecycle.stale(_stored(spark, sf_dir)["documents"], _now()).select("document_id")


STALE = f"WITH {_STORED} SELECT document_id FROM docs WHERE status = 'processing' AND coalesce(processing_started_at, created_at) < {NOW} - INTERVAL 10 MINUTE"


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: customers stand for collections, orders for documents."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "collection_id")
    return inventory.collection_counts(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "collection_id"), o)


COLLECTION_COUNTS = "SELECT c_custkey AS collection_id, count(o_orderkey) AS n_documents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return inventory.status_counts(table(spark, sf_dir, "orders"), ("O", "F", "P"), "o_orderstatus")


STATUS_COUNTS = """SELECT count(*) AS "all", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders"""


def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14."""
    return quality.user_status(_stored(spark, sf_dir)["documents"], "processing").select("document_id", "collection_id", "shown_status", "place")


DOCUMENT_LIST = f"WITH {_STORED} SELECT document_id, collection_id, 'processing' AS shown_status, row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, document_id)::INTEGER AS place FROM docs WHERE status IN ('processing', 'awaiting_upload')"


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines stand for documents and chunks."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = [
        quality.check_rows(o, "orders", {"status known": F.col("o_orderstatus").isin("O", "F"), "total": F.col("o_totalprice") > 1000}),
        quality.check_unique(n, "lineitem", ["l_orderkey", "l_linenumber"]),
        quality.check_reference(n, "lineitem", "l_orderkey", o.where("o_orderkey % 10 <> 0"), "o_orderkey"),
        quality.check_rows(n, "lineitem", {"quantity": F.col("l_quantity") >= 2}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CONSTRAINTS = """
SELECT 'orders' AS "table", 'status known' AS rule, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS violations FROM orders UNION ALL SELECT 'orders', 'total', count(*) FILTER (o_totalprice <= 1000) FROM orders
UNION ALL SELECT 'lineitem', 'unique(l_orderkey, l_linenumber)', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
UNION ALL SELECT 'lineitem', 'l_orderkey -> o_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)
UNION ALL SELECT 'lineitem', 'quantity', count(*) FILTER (l_quantity < 2) FROM lineitem
"""


def check_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label; one in 13 is missing, one in 17 is cut short."""
    e = table(spark, sf_dir, "embeddings")
    broken = F.when(F.col("vec_id") % 13 == 0, None).when(F.col("vec_id") % 17 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return quality.check_vectors(e.withColumn("embedding", broken), 64, ["label"])


CHECK_VECTORS = "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 13 = 0) AS n_missing, count(*) FILTER (vec_id % 13 <> 0 AND vec_id % 17 = 0) AS n_bad, count(*) FILTER (vec_id % 13 = 0) IN (0, count(*)) AS whole FROM embeddings GROUP BY label"


def mode_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10."""
    d = documents(spark, sf_dir)
    mode = lambda k: F.when(F.col("document_id") % k == 0, "privacy_minimised").otherwise("standard").alias("processing_mode")
    return quality.mode_changes(d.select("document_id", mode(6)), d.select("document_id", mode(10)))


MODE_CHANGES = """
WITH m AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 6 = 0 THEN 'privacy_minimised' ELSE 'standard' END AS old_mode, CASE WHEN doc_id % 10 = 0 THEN 'privacy_minimised' ELSE 'standard' END AS new_mode FROM documents)
SELECT * FROM m WHERE old_mode <> new_mode
"""


def sparse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages."""
    return quality.sparse_pages(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


SPARSE_PAGES = r"SELECT conv_id, turn FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) BETWEEN 1 AND 79 OR (text <> '' AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) < 12)"


def low_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth conversation has lost all but a few letters of its turns."""
    talk = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.substring("text", 1, 9)).otherwise(F.col("text")))
    return quality.low_text_documents(talk, ["conv_id"]).select("conv_id", "n_pages", "characters", "words")


LOW_TEXT = r"""
WITH p AS (SELECT conv_id, trim(regexp_replace(CASE WHEN conv_id % 5 = 0 THEN text[1:9] ELSE text END, '\s+', ' ', 'g')) AS t FROM conversations),
s AS (SELECT conv_id, count(*) AS n_pages, sum(length(t))::BIGINT AS characters, sum(len(list_filter(string_split(t, ' '), lambda x: x <> '')))::BIGINT AS words FROM p GROUP BY conv_id)
SELECT * FROM s WHERE characters < 80 OR words < 20 OR (n_pages > 3 AND characters / n_pages < 100)
"""


def tenant_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a line as its owner; customers see lines of suppliers of their own nation only."""
    seen = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    results = seen.select(F.col("o_orderkey").alias("query_id"), F.col("c_nationkey").alias("user_id"), F.col("l_suppkey").alias("document_id"))
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_nationkey").alias("user_id"))
    return quality.tenant_leaks(results, owners).groupBy("user_id", "owner_id").agg(F.count("*").alias("n"))


TENANT_LEAKS = """
SELECT c_nationkey AS user_id, s_nationkey AS owner_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL
"""


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: documents divisible by 3 come again, cut shorter."""
    old = chunks(spark, sf_dir).select("document_id", "chunk_index", F.md5("content").alias("content"))
    new = old.where("document_id % 3 = 0 and chunk_index < 2").withColumn("content", F.concat(F.lit("new "), "content"))
    return sinks.upsert_chunks(old, new)


UPSERT_CHUNKS = f"WITH {CHUNKS} SELECT document_id, chunk_index, CASE WHEN document_id % 3 = 0 THEN 'new ' ELSE '' END || md5(content) AS content FROM chunks WHERE document_id % 3 <> 0 OR chunk_index < 2"


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents divisible by 5 go, with their chunks."""
    d = documents(spark, sf_dir)
    left = sinks.delete_cascade({"documents": d, "chunks": chunks(spark, sf_dir)}, d.where("document_id % 5 = 0").select("document_id"))
    return left["documents"].select("document_id").groupBy("document_id").agg(F.lit(0).alias("chunk_index")).unionByName(left["chunks"].select("document_id", F.col("chunk_index") + 1).toDF("document_id", "chunk_index"))


DELETE_CASCADE = f"WITH {CHUNKS} SELECT document_id, 0 AS chunk_index FROM doc WHERE document_id % 5 <> 0 UNION ALL SELECT document_id, chunk_index + 1 FROM chunks WHERE document_id % 5 <> 0"

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "usage_summary usage_rolling usage_cost budget_decision strict_sums routes latency_percentiles pair_messages recent_messages transcript classify_storage incomplete_ready duplicate_paths manifest eligibility "
    "cleanup_plan lifecycle_sweep stale collection_counts status_counts document_list constraints check_vectors mode_changes sparse_pages low_text tenant_leaks upsert_chunks delete_cascade"
).split()}
