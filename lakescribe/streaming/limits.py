"""Structured Streaming: request windows, daily spend, a fixed-window limiter, a watchdog, duplicates, ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunking, pii, sanitize
from . import store


def sliding_counts(events: DataFrame, size: str = "1 minute", slide: str = "10 seconds", limit: int = 60, late: str = "1 minute") -> DataFrame:
    """user_id, window_start, window_end, n, over_limit of every sliding window; events: user_id, ts. State ends with the watermark."""
    e = events if not events.isStreaming else events.withWatermark("ts", late)
    n = e.groupBy("user_id", F.window("ts", size, slide)).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", (F.col("n") > limit).alias("over_limit"))


def daily_spend(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, day, n, spend_usd; events: user_id, ts, estimated_cost_usd."""
    e = events if not events.isStreaming else events.withWatermark("ts", late)
    s = e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum(F.col("estimated_cost_usd").cast("decimal(18,8)")).alias("spend_usd"))
    return s.select("user_id", F.to_date("window.start").alias("day"), "n", "spend_usd")


LIMITED = "event_id long, user_id long, ts timestamp, allowed boolean, remaining int"


def windows_used(at: np.ndarray, end: int, used: int, length: int) -> tuple[np.ndarray, int, int]:
    """Of rising times the place of each in its window, from 1, given the open window's end and use; and both of the last one.

    A window is found by halving, so that the walk takes a step a window and not one an event."""
    places, k = np.empty(len(at), np.int64), 0
    while k < len(at):
        if at[k] >= end:
            end, used = int(at[k]) + length, 0
        stop = int(np.searchsorted(at, end, "left"))
        places[k:stop] = used + np.arange(1, stop - k + 1)
        used, k = used + stop - k, stop
    return places, end, used


def fixed_window_limiter(events: DataFrame, limit: int = 5, window_s: int = 60, late: str = "1 minute") -> DataFrame:
    """Each event (event_id, user_id, ts) with allowed and remaining: a window starts at a user's first event and ends window_s later.

    State is a window's end and count for each user, and goes once the watermark has passed the end. Of a user's events of
    a batch a task holds times and ids, as it must put them in order, and gives out a frame as large as Spark gave it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(f["ts"].to_numpy("datetime64[us]").astype(np.int64), f["event_id"].to_numpy(np.int64)) for f in frames]
        sizes = np.cumsum([len(p[0]) for p in parts])
        at, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        end, used = state.get if state.exists else (0, 0)
        places, end, used = windows_used(at, end, used, window_s * 1_000_000)
        state.update((end, used))
        state.setTimeoutTimestamp(max(end // 1000, state.getCurrentWatermarkMs() + 1))
        for a, b in zip([0, *sizes[:-1]], sizes, strict=True):
            yield pd.DataFrame({"event_id": ids[a:b], "user_id": key[0], "ts": at[a:b].astype("datetime64[us]"), "allowed": places[a:b] <= limit, "remaining": np.maximum(0, limit - places[a:b]).astype(np.int32)})

    return events.withWatermark("ts", late).select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(step, LIMITED, "end_us long, used int", "append", GroupStateTimeout.EventTimeTimeout)


STALLED = "document_id long, stage string, since timestamp, message string"


def stall_watchdog(stages: DataFrame, minutes: int = 6, late: str = "1 minute") -> DataFrame:
    """A row for each document that hasn't left its stage for so long; stages: document_id, stage, ts; ready and failed end a document."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, since = state.get
            state.remove()
            label = stage.replace("_", " ")
            yield pd.DataFrame({"document_id": [key[0]], "stage": [stage], "since": [pd.Timestamp(since, unit="us")], "message": [f"{label}: Processing stopped making progress. Retry to try again."]})
            return
        last = pd.concat(list(frames)).sort_values("ts").iloc[-1]
        at = last["ts"].value // 1000
        if state.exists and state.get[1] > at:
            return
        if last["stage"] in ("ready", "failed"):
            if state.exists:
                state.remove()
            return
        state.update((last["stage"], at))
        state.setTimeoutTimestamp(max(at // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return stages.withWatermark("ts", late).groupBy("document_id").applyInPandasWithState(step, STALLED, "stage string, since_us long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_content(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """docs (collection_id, text, ts) without those whose content the collection had within the watermark; a batch: at all."""
    hashed = docs.withColumn("content_sha256", F.sha2("text", 256))
    if not docs.isStreaming:
        return hashed.dropDuplicates(["collection_id", "content_sha256"])
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["collection_id", "content_sha256"])


def chunk_stream(docs: DataFrame, secret: str | None = None) -> DataFrame:
    """document_id, chunk_index, content of arriving documents, cleaned; no state.

    With secret docs have user_id and processing_mode too, and each chunk has embedding_projection and embedding_text: the
    masked text of a private document's chunk, the text of another's.
    """
    own = ["document_id"] if secret is None else ["document_id", "user_id", "processing_mode"]
    cut = chunking.chunk_documents(docs.withColumn("text", sanitize.clean(F.col("text"))), own, "text")
    if secret is None:
        return cut
    private = F.col("processing_mode") == "privacy_minimised"
    masked = pii.mask(F.when(private, F.col("content")), pii.scope_id(F.col("user_id"), F.col("document_id")), secret)
    return cut.select("document_id", "chunk_index", "content", F.when(private, "privacy_minimised").otherwise("original").alias("embedding_projection"), F.when(private, masked).otherwise(F.col("content")).alias("embedding_text"))


def chunk_schema(docs: DataFrame, secret: str | None = None) -> str:
    """The columns of a table of chunk_stream()'s rows."""
    kind = docs.schema["document_id"].dataType.simpleString()
    return f"document_id {kind}, chunk_index int, content string" + (", embedding_projection string, embedding_text string" if secret else "")


def ingest(docs: DataFrame, path: str, checkpoint: str, secret: str | None = None, buckets: int = 64, available_now: bool = False):
    """A running query that keeps the chunks of arriving documents in a table at path, exactly once: store.read gives it as the
    last commit left it, and path itself holds a plain copy by bucket.

    Of a document's versions the last counts: by event_order (long) where docs have it, in a batch and across batches;
    without it by batch, and in a batch by the text. A deleted one (boolean column deleted), and one without text, loses
    its chunks. checkpoint also names the query: its batches are known by it, so that a batch that is run again does nothing.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        own = batch
        if "event_order" not in batch.columns:
            own = own.withColumn("event_order", F.lit(store.next_order(batch.sparkSession, path)))
        if "deleted" not in batch.columns:
            own = own.withColumn("deleted", F.lit(False))
        store.replace(batch.sparkSession, path, own, lambda events: chunk_stream(events, secret), chunk_schema(docs, secret), checkpoint, batch_id, buckets, published=True)

    run = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (run.trigger(availableNow=True) if available_now else run).start()
