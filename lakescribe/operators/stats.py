"""Latencies and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency(events: DataFrame, keys: list[str], value: str, ok: str, levels: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys, n, errors, error_rate and nearest-rank percentiles p50, p95, p99 of value.

    Values are first counted by key, so a group's sorted rows are its distinct values.
    """
    counts = events.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.count_if(~F.col(ok)).alias("_errors"))
    up_to = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    ranked = counts.withColumn("_up", F.sum(known).over(up_to)).withColumn("_all", F.sum(known).over(whole))
    level = lambda q: F.min(F.when(F.col("_up") >= F.ceil(F.col("_all") * F.lit(q)), F.col(value))).alias(f"p{round(100 * q)}")
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_errors").alias("errors"), *[level(q) for q in levels]).withColumn("error_rate", F.col("errors") / F.col("n"))
