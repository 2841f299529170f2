"""Documents that don't get on: expired uploads, stalled processing, objects that came too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPLOAD_MINUTES, STALL_MINUTES, STALE_MINUTES, LATE_MINUTES = 60, 6, 10, 125
EXPIRED = "Upload did not complete. Upload the file again."


def _ago(now: Column, minutes: int) -> Column:
    return now - F.expr(f"INTERVAL {minutes} MINUTES")


def stalled_message(stage: Column) -> Column:
    return F.concat(F.coalesce(F.regexp_replace(stage, "_", " "), F.lit("processing")), F.lit(": Processing stopped making progress. Retry to try again."))


def sweep(docs: DataFrame, now: Column, upload_minutes: int = UPLOAD_MINUTES, stall_minutes: int = STALL_MINUTES, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """docs (status, processing_stage, created_at, processing_stage_updated_at, upload_expired_at) with action, next_status and message; null where nothing is to be done."""
    expired = (F.col("status") == "awaiting_upload") & (F.col("created_at") < _ago(now, upload_minutes))
    stalled = (F.col("status") == "processing") & (F.coalesce("processing_stage_updated_at", "created_at") < _ago(now, stall_minutes))
    late = (F.col("status") == "failed") & F.col("upload_expired_at").isNotNull() & (F.col("created_at") < _ago(now, late_minutes))
    action = F.when(expired, "expire_upload").when(stalled, "fail_stalled").when(late, "remove_late_object")
    return docs.withColumn("action", action).select(
        "*",
        F.when(F.col("action").isin("expire_upload", "fail_stalled"), "failed").when(F.col("action").isNotNull(), F.col("status")).alias("next_status"),
        F.when(F.col("action") == "expire_upload", EXPIRED).when(F.col("action") == "fail_stalled", stalled_message(F.col("processing_stage"))).alias("message"),
    )


def stale(docs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """docs that have been processing for longer; a missing start is the time of creation."""
    return docs.where((F.col("status") == "processing") & (F.coalesce("processing_started_at", "created_at") < _ago(now, minutes)))
