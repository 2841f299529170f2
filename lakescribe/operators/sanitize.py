"""Cleaning of text that others wrote: control and invisible characters, source tags, text that reads like instructions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
INVISIBLE = "[​-‍⁠﻿]"
# Rule, pattern, what stands in its place; applied in this order, case ignored.
RULES = (
    ("source_delimiter", r"</?source\b[^>]*>", "[source delimiter removed]"),
    ("prompt_injection_pattern", r"\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|rules?|messages?)\b", "[instruction-like text removed]"),
    ("prompt_injection_pattern", r"\b(?:reveal|show|print|output|leak)\s+(?:the\s+)?(?:system prompt|developer message|hidden instructions?)\b", "[instruction-like text removed]"),
    ("prompt_injection_pattern", r"\b(?:you are now|act as|roleplay as)\s+(?:the\s+)?(?:system|developer|assistant)\b", "[instruction-like text removed]"),
)


def clean(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), INVISIBLE, "")
    return reduce(lambda x, rule: F.regexp_replace(x, f"(?i){rule[1]}", F.lit(rule[2])), RULES, bare)


def suspicious(text: Column) -> Column:
    """Whether cleaning changes anything; a cheap test before events are looked for."""
    return reduce(lambda x, rule: x | text.rlike(f"(?i){rule[1]}"), RULES, text.rlike(f"{CONTROL}|{INVISIBLE}"))


_ODD = re.compile(f"({CONTROL})|{INVISIBLE}")
_PATTERNS = [(rule, re.compile(pattern, re.I | re.A), new) for rule, pattern, new in RULES]


def _events(text: str) -> list[tuple[str, int, int]]:
    """Characters by their place in the text; patterns by theirs in the text as the rules before have left it."""
    out = [("control_character" if m[1] else "zero_width_character", m.start(), 1) for m in _ODD.finditer(text)]
    staged = _ODD.sub("", text) if out else text
    for rule, pattern, new in _PATTERNS:
        out += [(rule, m.start(), len(m[0])) for m in pattern.finditer(staged)]
        staged = pattern.sub(new, staged)
    return out


def events(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, rule_id, offset, length: a row for each thing that cleaning removes. Offsets are in code points."""

    @F.pandas_udf("array<struct<rule_id:string,offset:int,length:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(_events)

    return units.where(suspicious(F.col(text))).select(*keys, F.explode(found(F.col(text))).alias("e")).select(*keys, "e.*")


def event_counts(text: Column) -> Column:
    """An array of structs of rule_id and n: how often each rule finds something, without user functions."""
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    bare = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), INVISIBLE, "")
    found, staged = [("control_character", count(text, CONTROL)), ("zero_width_character", count(text, INVISIBLE))], bare
    for rule, pattern, new in RULES:
        found.append((rule, count(staged, f"(?i){pattern}")))
        staged = F.regexp_replace(staged, f"(?i){pattern}", F.lit(new))
    return F.filter(F.array(*[F.struct(F.lit(rule).alias("rule_id"), n.cast("long").alias("n")) for rule, n in found]), lambda x: x["n"] > 0)


def event_summary(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, rule_id, n: how many events of each rule a document has."""
    one = units.where(suspicious(F.col(text))).select(*keys, F.explode(event_counts(F.col(text))).alias("e"))
    return one.groupBy(*keys, F.col("e.rule_id").alias("rule_id")).agg(F.sum("e.n").alias("n"))
