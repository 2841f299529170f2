"""Numbers and running values within groups of any size.

A window function takes a group's rows to one task. That is right for groups that a task can hold; groups of more rows are
cut into segments: their rows are dealt out by ranges of (group, order), each range is worked on by itself, and what a
range must know of those before it is a small sum for each (range, group), of which there are no more than ranges and
groups together. The rows of large groups are written once, as the ranges must be the same in both passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..sources.shared import kept

#: Rows of a group that one task may hold.
IN_TASK = 1_000_000


def large_groups(df: DataFrame, keys: list[str], in_task: int = IN_TASK) -> DataFrame | None:
    """keys and n of groups of more than in_task rows; None if there are none. Counted in map-side sums."""
    n = fresh(df, "_n")[0]
    large = df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > in_task)
    return large if large.take(1) else None


def segments(df: DataFrame, keys: list[str], order: list[Column | str], segment: str, place: str) -> DataFrame:
    """df with the range its row is in and the row's place in that: sorted by keys and order from range to range; written."""
    by = [*[F.col(f"`{k}`") for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(max(conf, df.sparkSession.sparkContext.defaultParallelism), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()  # the range's number, then the place in it
    return kept(dealt.withColumn(place, at).withColumn(segment, F.shiftright(place, 33).cast("int")).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1))))


def _split(df: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of large groups and the others. Null keys are equal. large isn't broadcast unless Spark sees that it is small."""
    names = [f"_k{i}" for i in range(len(keys))]
    own = large.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)])
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & df[f"`{k}`"].eqNullSafe(own[n])
    return df.join(own, same, "left_semi"), df.join(own, same, "left_anti")


def row_numbers(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_number", count: str | None = None, in_task: int = IN_TASK) -> DataFrame:
    """df with the row's number in its group, from 1 by order (long), and with count the group's rows.

    order should tell a group's rows apart; among rows that it doesn't, numbers are arbitrary. Null keys are a group. Groups
    of more than in_task rows are numbered by ranges; whether there are any is counted when this is called.
    """
    own = Window.partitionBy(*keys)

    def by_window(part: DataFrame) -> DataFrame:
        out = part.withColumn(name, F.row_number().over(own.orderBy(*order)).cast("long"))
        return out.withColumn(count, F.count("*").over(own)) if count else out

    large = large_groups(df, keys, in_task)
    if large is None:
        return by_window(df)
    hot, rest = _split(df, keys, large)
    segment, place, n, first, before, total = fresh(df, "_segment", "_place", "_rows", "_first", "_before", "_total")
    cut = segments(hot, keys, order, segment, place)
    sums = cut.groupBy(*keys, segment).agg(F.count("*").alias(n), F.min(place).alias(first))
    earlier = own.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).withColumn(total, F.sum(n).over(own))  # a row a range and group
    out = _joined(cut, sums.drop(n), [*keys, segment]).withColumn(name, F.col(before) + F.col(place) - F.col(first) + 1)
    out = out.withColumn(count, F.col(total)) if count else out
    return out.drop(segment, place, first, before, total).unionByName(by_window(rest))


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the row of small that has its keys: at most ranges and large groups together, so each task may hold it."""
    names = [f"_j{i}" for i in range(len(keys))]
    own = small
    for k, n in zip(keys, names, strict=True):
        own = own.withColumnRenamed(k, n)
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & df[f"`{k}`"].eqNullSafe(own[n])
    return df.join(F.broadcast(own), same).drop(*names)


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], within: Callable[[Column], Column], in_task: int = IN_TASK) -> DataFrame:
    """df with, for each of values, the running within() of it up to the row: a function that may be taken of parts and of
    its own results, such as a maximum or the last value by order. Groups of more than in_task rows by ranges."""
    so_far = lambda keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def by_window(part: DataFrame, keys: list[str]) -> DataFrame:
        return part.select("*", *[within(v).over(so_far(keys)).alias(c) for c, v in values.items()])

    large = large_groups(df, keys, in_task)
    if large is None:
        return by_window(df, keys)
    hot, rest = _split(df, keys, large)
    segment, place = fresh(df, "_segment", "_place")
    carried = fresh(df, *[f"_c{k}" for k in range(len(values))])
    cut = segments(hot, keys, [order], segment, place)
    sums = cut.groupBy(*keys, segment).agg(*[within(v).alias(c) for c, v in zip(carried, values.values(), strict=True)])
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, segment, *[within(F.col(c)).over(earlier).alias(c) for c in carried])
    local = _joined(by_window(cut, [*keys, segment]), sums, [*keys, segment])  # a range's rows of a group in a task
    for c, before in zip(values, carried, strict=True):
        local = local.withColumn(c, F.greatest(F.col(before), F.col(c)))
    return local.drop(segment, place, *carried).unionByName(by_window(rest, keys))
