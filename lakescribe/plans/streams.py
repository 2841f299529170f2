"""Queries that run as streams over the given tables, all that is there at once, and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import limits, store
from .common import workspace
from .evidence import SECRET
from .privacy import BARE


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: the table may be a file or a folder


def _drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream has to say about all that is there."""
    folder = workspace(spark)
    out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: three events of a user in a window of a day that starts with the first."""
    return _drained(spark, limits.fixed_window_limiter(_events(spark, sf_dir), limit=3, window_s=86_400)).select("event_id", "user_id", "allowed", "remaining")


STREAM_LIMITER = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, k, ts + INTERVAL 1 DAY AS until, 1 AS used FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.ts >= w.until THEN e.ts + INTERVAL 1 DAY ELSE w.until END, CASE WHEN e.ts >= w.until THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, user_id, used <= 3 AS allowed, greatest(0, 3 - used)::INTEGER AS remaining FROM w
"""


def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for documents, kinds of events for stages; a sign-up ends a document, and who has stood still for six hours has stalled."""
    s = _events(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "signup", "ready").otherwise(F.concat(F.col("event_type"), F.lit("_stage"))).alias("stage"), "ts")
    return _drained(spark, limits.stall_watchdog(s, minutes=360)).select("document_id", "stage", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "message")


STREAM_WATCHDOG = """
WITH l AS (SELECT user_id, max_by(event_type, ts) AS t, max(ts) AS ts FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id AS document_id, t || '_stage' AS stage, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since, t || ' stage: Processing stopped making progress. Retry to try again.' AS message FROM l, m WHERE t <> 'signup' AND ts + INTERVAL 360 MINUTE <= now - INTERVAL 1 MINUTE
"""


def stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive within an hour of each other; of each content a collection gets one."""
    d = _stream(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), "text", F.timestamp_seconds(F.col("doc_id") % 3000 + 1).alias("ts"))
    return _drained(spark, limits.dedup_content(d)).select("collection_id", "content_sha256")


STREAM_DUPLICATES = "SELECT DISTINCT source AS collection_id, sha256(text) AS content_sha256 FROM documents"


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2 as streams: windows of a day that have ended, by user; what a user spent in them."""
    e = _events(spark, sf_dir).select("user_id", "ts", (F.col("value") / 1000).alias("estimated_cost_usd"))
    n = _drained(spark, limits.sliding_counts(e, "1 day", "1 day", 5)).select("user_id", F.to_date("window_start").alias("day"), F.col("n").alias("n_requests"), "over_limit")
    spent = _drained(spark, limits.daily_spend(e)).select("user_id", "day", F.round(F.col("spend_usd").cast("double"), 6).alias("spend_usd"))
    return n.join(spent, ["user_id", "day"])


STREAM_COUNTS = """
WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT user_id, ts::DATE AS day, count(*) AS n_requests, round(sum((value / 1000)::DECIMAL(18,8))::DOUBLE, 6) AS spend_usd FROM events GROUP BY ALL)
SELECT user_id, day, n_requests, n_requests > 5 AS over_limit, spend_usd FROM d, m WHERE day + INTERVAL 1 DAY <= now - INTERVAL 1 HOUR
"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' letters arrive as documents and come to a table as chunks, the private ones masked; those of odd keys come again, longer."""
    key = F.col("c_custkey").cast("string")
    folder = workspace(spark)
    letters = _stream(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("document_id"), F.lit("u1").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "privacy_minimised").otherwise("standard").alias("processing_mode"),
        F.concat(F.lit("Letter\x07 "), key, F.lit(" of user"), key, F.lit("@mail.example.org"), F.repeat(F.lit(" word"), (F.col("c_custkey") % 2 * 390).cast("int"))).alias("text"),
    )
    limits.ingest(letters, f"{folder}/chunks", f"{folder}/first", SECRET, 8, available_now=True).awaitTermination()
    again = letters.where("document_id % 2 = 1").withColumn("text", F.concat(F.lit("Again. "), "text"))
    limits.ingest(again, f"{folder}/chunks", f"{folder}/second", SECRET, 8, available_now=True).awaitTermination()
    c = store.read(spark, f"{folder}/chunks", limits.chunk_schema(letters, SECRET))
    return c.select("document_id", "chunk_index", "embedding_projection", F.md5(F.regexp_replace("embedding_text", BARE, "]")).alias("text_md5"))


STREAM_INGEST = """
WITH t AS (SELECT c_custkey AS document_id, c_custkey % 3 = 0 AS private, string_split(CASE WHEN c_custkey % 2 = 1 THEN 'Again. ' ELSE '' END || 'Letter ' || c_custkey || ' of ' || CASE WHEN c_custkey % 3 = 0 THEN '[EMAIL]' ELSE 'user' || c_custkey || '@mail.example.org' END || repeat(' word', (c_custkey % 2 * 390)::INTEGER), ' ') AS w FROM customer),
c AS (SELECT *, unnest(range(CASE WHEN len(w) <= 384 THEN 1 ELSE 2 END))::INTEGER AS chunk_index FROM t)
SELECT document_id, chunk_index, CASE WHEN private THEN 'privacy_minimised' ELSE 'original' END AS embedding_projection, md5(array_to_string(w[chunk_index * 346 + 1:chunk_index * 346 + 384], ' ')) AS text_md5 FROM c
"""

def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 with everything that may happen to a document, as one batch and then as many: events of users stand for versions of
    documents, in any order and repeated; errors delete a document, views empty it; what is left is the last version of each."""
    folder = workspace(spark)
    e = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("event_order"), (F.col("event_type") == "error").alias("deleted"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("Version "), F.col("event_id").cast("string"), F.repeat(F.lit(" word"), (F.col("event_id") % 500).cast("int")))).otherwise("").alias("text"),
    )
    late, early = e.where("event_order % 3 <> 0"), e.where("event_order % 3 <> 1")  # later versions first, some of them twice
    for name, part in (("late", late), ("early", early)):
        limits.ingest(part, f"{folder}/chunks", f"{folder}/{name}", None, 8, available_now=True).awaitTermination()
    c = store.read(spark, f"{folder}/chunks", limits.chunk_schema(e))
    return c.select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


STREAM_UPSERTS = """
WITH l AS (SELECT user_id AS document_id, max(event_id) AS v, max_by(event_type, event_id) AS t FROM events GROUP BY user_id),
w AS (SELECT document_id, string_split('Version ' || v || repeat(' word', (v % 500)::INTEGER), ' ') AS w FROM l WHERE t NOT IN ('error', 'view')),
c AS (SELECT *, unnest(range(CASE WHEN len(w) <= 384 THEN 1 ELSE 2 END))::INTEGER AS chunk_index FROM w)
SELECT document_id, chunk_index, md5(array_to_string(w[chunk_index * 346 + 1:chunk_index * 346 + 384], ' ')) AS content_md5 FROM c
"""

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in "stream_limiter stream_watchdog stream_duplicates stream_counts stream_ingest stream_upserts".split()}
