"""Usage of models: what was asked and spent, and whether one more request may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_S, INVENTORY_MODEL = 60, "document_inventory"
#: Limits; all are arguments of decide().
LIMITS = {"enabled": True, "most_input_tokens": 6000, "per_minute": 5, "per_day": 30, "budget_inr": 50.0, "inr_per_usd": 85.0}
#: Of a model without a known price: the dearest known, dollars a million tokens.
DEAREST = (3.0, 15.0)


def micros(at: Column) -> Column:
    """Microseconds of a time, with or without a zone."""
    return F.unix_micros(at.cast("timestamp"))


def counted() -> Column:
    """Events that count: not blocked, and no inventory answers, which cost nothing."""
    return (F.col("status") != "blocked") & (F.col("model") != INVENTORY_MODEL)


def summarize(events: DataFrame, now: Column) -> DataFrame:
    """user_id, daily_requests, daily_spend_usd, minute_requests, oldest_minute_at as of now: the UTC day and the last 60 seconds."""
    e = events.where(counted() & (F.col("created_at") >= F.date_trunc("day", now)) & (F.col("created_at") <= now))
    recent = F.col("created_at") >= now - F.expr(f"INTERVAL {MINUTE_S} SECONDS")
    return e.groupBy("user_id").agg(
        F.count("*").alias("daily_requests"),
        F.sum(F.col("estimated_cost_usd").cast("decimal(18,8)")).alias("daily_spend_usd"),
        F.count_if(recent).alias("minute_requests"),
        F.min(F.when(recent, F.col("created_at"))).alias("oldest_minute_at"),
    )


def rolling(events: DataFrame) -> DataFrame:
    """event_id, user_id, minute_requests, daily_requests, daily_spend_usd as of each event that counts, itself included; days are UTC's.

    A group is an hour of a user, however long the history: events of an hour's last minute are seen by the next hour too,
    and what the day's hours before add up to, 24 rows at most, is joined.
    """
    us, hour, last = F.col("us"), 3_600_000_000, MINUTE_S * 1_000_000
    e = events.where(counted()).select("event_id", "user_id", micros(F.col("created_at")).alias("us"), F.col("estimated_cost_usd").cast("decimal(18,8)").alias("cost"), F.lit(1).alias("own"))
    e = e.withColumn("hour", F.floor(us / hour))
    seen = e.unionByName(e.where(us - F.col("hour") * hour >= hour - last).withColumn("hour", F.col("hour") + 1).withColumn("own", F.lit(0)))
    by = Window.partitionBy("user_id", "hour").orderBy("us")
    so_far = by.rangeBetween(Window.unboundedPreceding, 0)
    within = seen.select(
        "event_id", "user_id", "hour", "own", F.count("*").over(by.rangeBetween(-last, 0)).alias("minute_requests"),
        F.sum("own").over(so_far).alias("n"), F.sum(F.when(F.col("own") == 1, F.col("cost"))).over(so_far).alias("cost"),
    ).where("own = 1")
    earlier = Window.partitionBy("user_id", F.floor(F.col("hour") / 24)).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = e.groupBy("user_id", "hour").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    before = before.select("user_id", "hour", F.sum("n").over(earlier).alias("n_before"), F.sum("cost").over(earlier).alias("cost_before"))
    nothing = F.lit(0).cast("decimal(18,8)")
    both = within.join(before, ["user_id", "hour"])
    spent = F.when(F.col("cost").isNotNull() | F.col("cost_before").isNotNull(), F.coalesce("cost", nothing) + F.coalesce("cost_before", nothing))
    return both.select("event_id", "user_id", "minute_requests", (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("daily_requests"), spent.alias("daily_spend_usd"))


def retry_after_minute(oldest: Column, now: Column) -> Column:
    left = micros(oldest) + F.lit(MINUTE_S * 1_000_000) - micros(now)
    return F.greatest(F.lit(1), F.coalesce(F.ceil(left / 1_000_000), F.lit(MINUTE_S))).cast("int")


def retry_after_day(now: Column) -> Column:
    left = micros(F.date_trunc("day", now)) + F.lit(86_400_000_000) - micros(now)
    return F.greatest(F.lit(1), F.ceil(left / 1_000_000)).cast("int")


def cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """events (model, input_tokens, output_tokens) with cost_usd. prices: model, input_usd, output_usd a million tokens, small.

    A model without a price, or with one that can't be, costs as the dearest known.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    valid = prices.where(good("input_usd") & good("output_usd")).dropDuplicates(["model"])
    joined = events.join(valid, "model", "left")
    each = F.col("input_tokens") * F.coalesce("input_usd", F.lit(DEAREST[0])) + F.col("output_tokens") * F.coalesce("output_usd", F.lit(DEAREST[1]))
    return joined.withColumn("cost_usd", each / 1_000_000).drop("input_usd", "output_usd")


def decide(requests: DataFrame, snapshot: DataFrame, now: Column, **limits: float) -> DataFrame:
    """requests (user_id, input_tokens, cost_usd) with status, reason and retry_after_s; the first reason that holds counts."""
    m = LIMITS | limits
    r = requests.join(snapshot, "user_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    spend = (number("daily_spend_usd").cast("double") + F.col("cost_usd")) * m["inr_per_usd"]
    reason = (
        F.when(F.lit(not m["enabled"]), "ai_disabled")
        .when(F.col("input_tokens") > m["most_input_tokens"], "prompt_too_large")
        .when(number("minute_requests") >= m["per_minute"], "minute_rate_limit")
        .when(number("daily_requests") >= m["per_day"], "daily_request_limit")
        .when(spend > m["budget_inr"], "daily_budget_limit")
        .otherwise("allowed")
    )
    out = r.withColumn("reason", reason)
    wait = F.when(F.col("reason") == "minute_rate_limit", retry_after_minute(F.col("oldest_minute_at"), now)).when(F.col("reason").isin("daily_request_limit", "daily_budget_limit"), retry_after_day(now))
    return out.select(*requests.columns, F.when(F.col("reason") == "allowed", "allowed").otherwise("blocked").alias("status"), "reason", wait.alias("retry_after_s"))


# What makes a question hard.
HARD = r"\b(compare|contrast|analy[sz]e|evaluate|risks?|conflicts?|inconsisten\w*|legal|contract\w*|obligations?|synthesi[sz]e|reconcile|why)\b"


def route_model(question: Column, n_chunks: Column, fast: str = "fast", strong: str = "strong", most_chunks: int = 8, most_characters: int = 900) -> Column:
    """Struct of model and reason: a hard question, many chunks or a long question take the strong model."""
    answer = lambda model, why: F.struct(F.lit(model).alias("model"), F.lit(why).alias("reason"))
    return (
        F.when(question.rlike(f"(?i){HARD}"), answer(strong, "question_pattern"))
        .when(n_chunks >= most_chunks, answer(strong, "many_chunks"))
        .when(F.length(question) > most_characters, answer(strong, "long_question"))
        .otherwise(answer(fast, "default"))
    )


def strict_sum(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, total: null unless every row of the group has a value."""
    return df.groupBy(*keys).agg(F.when(F.count(column) == F.count("*"), F.sum(column)).alias("total"))
