"""Column expressions over text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the data's rules mean it: also the no-break space and the byte-order mark.
BLANK = r"[\s ﻿]"
WORDS_PER_TOKEN, CHARACTERS_PER_TOKEN = 1.3, 4


def normalize(text: Column) -> Column:
    """Lower case, apostrophes dropped, every run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """The words of the normalised text."""
    return F.filter(F.split(normalize(text), " "), lambda x: x != "")


def collapse(text: Column) -> Column:
    """Every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def normalize_block(text: Column) -> Column:
    """Line ends \\n, spaces in a line collapsed, three or more line ends two."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(unix, r"[ \t ]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words by white space; null and blank text have none."""
    return F.array_remove(F.split(collapse(F.coalesce(text, F.lit(""))), " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(text: Column) -> Column:
    """By words, 1.3 each."""
    return F.ceil(count_words(text) * F.lit(WORDS_PER_TOKEN)).cast("int")


def estimate_tokens_by_length(text: Column) -> Column:
    """By characters, 4 each."""
    return F.ceil(F.length(text) / CHARACTERS_PER_TOKEN).cast("int")


def plain_letters(text: Column) -> Column:
    """Compatibility-decomposed, without combining marks: é is e."""

    @F.pandas_udf("string")
    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return strip(text)


def slugify(text: Column, most: int = 80) -> Column:
    """Letters and digits in lower case, joined by hyphens; nothing left: report."""
    slug = F.trim(F.regexp_replace(F.lower(plain_letters(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "report").otherwise(F.substring(slug, 1, most))


def has_executable_markup(text: Column) -> Column:
    return text.rlike(r"(?i)<\s*/?\s*(script|iframe|object|embed|svg|math|style|link|meta|form)\b|\bon[a-z]+\s*=|javascript\s*:")


def inline_tokens(text: Column) -> Column:
    """Citations [[s.1]], `code`, **strong** and plain text, in order, as structs of kind and value."""
    found = F.regexp_extract_all(text, F.lit(r"(\[\[[sp]\.\d+\]\]|`[^`\n]+`|\*\*[^*\n]+\*\*|(?:(?!\[\[[sp]\.\d+\]\]|`[^`\n]+`|\*\*[^*\n]+\*\*)[\s\S])+)"))

    def typed(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^\[\[[sp]\.\d+\]\]$"), F.struct(F.lit("citation").alias("kind"), F.regexp_extract(x, r"([sp]\.\d+)", 1).alias("value")))
            .when(x.rlike(r"^`[^`\n]+`$"), F.struct(F.lit("code").alias("kind"), F.regexp_replace(x, "`", "").alias("value")))
            .when(x.rlike(r"^\*\*[^*\n]+\*\*$"), F.struct(F.lit("strong").alias("kind"), F.regexp_replace(x, r"\*\*", "").alias("value")))
            .otherwise(F.struct(F.lit("text").alias("kind"), x.alias("value")))
        )

    return F.transform(found, typed)
