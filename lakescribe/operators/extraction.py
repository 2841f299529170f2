"""Files of every kind to units, by a registry of extractors.

A document's kind picks its extractor, which gives the document's units or says why it gives none; a file that can't be
read fails its own row and no other. One pass over the documents, no shuffle: texts are cut by Column expressions, the
kinds that need an automaton by one Arrow-batched function that looks the kind up row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files
from ..functions.text import collapse
from . import delimited, markdown, markup, quality, units

UNIT = (
    "struct<block_type:string,text:string,heading_path:array<string>,location_label:string,source_location:string,"
    "line_start:int,line_end:int,row_start:int,row_end:int,code_language:string,table_context:string,title:string>"
)
_FIELDS = [x.split(":")[0] for x in UNIT[7:-1].split(",")]


class Refused(Exception):
    """A file that an extractor won't read; its one argument is the error's name."""


class Extractor(NamedTuple):
    """What makes a kind's units: from the file's bytes, as dicts of UNIT's fields, or as a Column of its text.

    least: characters and words that the units must have; stage: where a document without them fails. strict: whether the
    bytes must be UTF-8.
    """

    method: str
    from_bytes: Callable[[bytes], list[dict]] | None = None
    from_column: Callable[[Column], Column] | None = None
    least: tuple[int, int] = (10, 1)
    stage: str = "extracting"
    strict: bool = True


def _html(data: bytes) -> list[dict]:
    page = markup.decode_html(data)
    if markup.UNSAFE.search(page):
        raise Refused("unsafe_markup")
    found = markup.html_units(page)
    return [
        {"block_type": kind, "text": text, "heading_path": path, "location_label": f"Heading: {text}" if kind == "heading" else where, "source_location": where, "code_language": language, "table_context": table, "title": title}
        for kind, text, path, where, language, table, title in found
    ]


def _markdown(data: bytes) -> list[dict]:
    return [
        {"block_type": kind, "text": text, "heading_path": path, "location_label": f"Heading: {text}" if kind == "heading" else f"Line {line}", "source_location": where, "line_start": line, "code_language": language, "table_context": columns}
        for kind, text, path, where, language, columns, line in markdown.markdown_units(data.decode("utf-8", "replace"))
    ]


def _csv(data: bytes) -> list[dict]:
    """Units of whole rows under the columns' names, as units.table_units makes them of a table."""
    rows = delimited.read_rows(data.decode("utf-8", "replace"))
    if not rows:
        return []
    names = [h or f"Column {k + 1}" for k, h in enumerate(rows[0])]
    body, out = rows[1:], []
    size = units.ROWS if -(-len(body) // units.ROWS) <= units.MOST_UNITS else -(-len(body) // units.MOST_UNITS)

    def said(number: int, row: list[str]) -> str:
        width = max(len(names), len(row))
        full = names + [f"Column {k + 1}" for k in range(len(names), width)]
        return f"Row {number}: " + "; ".join(f"{h}: {v or '[blank]'}" for h, v in zip(full, row + [""] * (width - len(row)), strict=True))

    for k in range(0, len(body), size):
        part, first = body[k : k + size], k + 2
        last = first + len(part) - 1
        text = "\n".join([f"Columns: {' | '.join(names)}", *(said(first + j, row) for j, row in enumerate(part))])
        out.append({"block_type": "table_row", "text": text, "location_label": f"Rows {first}-{last}", "source_location": f"rows:{first}-{last}", "row_start": first, "row_end": last, "table_context": f"CSV columns: {' | '.join(names)}"})
    return out


def line_units(text: Column, lines_per_unit: int = units.LINES) -> Column:
    """As units.from_text, as an array of UNIT."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")

    def of(all_lines: Column) -> Column:
        def unit(part: Column, k: Column) -> Column:
            first = k * lines_per_unit + 1
            last = F.least((k + 1) * lines_per_unit, F.size(all_lines))
            span = F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
            null = lambda kind: F.lit(None).cast(kind)
            return F.struct(
                F.lit("text").alias("block_type"), F.trim(F.array_join(part, "\n")).alias("text"), null("array<string>").alias("heading_path"), F.concat(F.lit("Lines "), span).alias("location_label"), F.concat(F.lit("lines:"), span).alias("source_location"),
                first.cast("int").alias("line_start"), last.cast("int").alias("line_end"), null("int").alias("row_start"), null("int").alias("row_end"), null("string").alias("code_language"), null("string").alias("table_context"), null("string").alias("title"),
            )

        return F.filter(F.transform(units._groups(all_lines, lines_per_unit), unit), lambda u: collapse(u["text"]) != "")

    return F.element_at(F.transform(F.array(lines), of), 1)  # the lines are split once


#: kind of file -> what makes its units. A caller may give another registry, with kinds of its own.
EXTRACTORS: dict[str, Extractor] = {
    "text": Extractor("plain_text", from_column=line_units, least=(10, 2), stage="validating"),
    "html": Extractor("html", _html, least=(10, 2), strict=False),
    "markdown": Extractor("markdown", _markdown),
    "csv": Extractor("csv", _csv),
}
#: Characters that text files don't hold, and the share of them among a file's first bytes from which it is binary.
_CONTROL = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 32)]))
SAMPLE, BINARY_SHARE = 4096, 0.03


def looks_binary(content: Column) -> Column:
    """By the first bytes: a NUL, or too many control characters; without user functions."""
    head = F.substring(content, 1, SAMPLE)
    said = head.cast("string")
    control = F.octet_length(said) - F.octet_length(F.translate(said, _CONTROL, ""))
    return (F.octet_length(head) > 0) & (F.contains(said, F.lit("\x00")) | (control > F.octet_length(head) * BINARY_SHARE))


def extracted(docs: DataFrame, extractors: dict[str, Extractor] | None = None, kind: str = "kind", content: str = "content", wanted: Column | None = None) -> DataFrame:
    """docs with units (array of UNIT, null where there are none to have) and extract_error.

    kind: a file's kind, null or unknown: no_extractor. content: its bytes; null counts as empty. wanted: rows for which it
    isn't true are left alone, with neither units nor error. What an extractor raises is its row's error: a Refused by its
    name, anything else as extraction_failed. Empty tables give empty ones.
    """
    own = EXTRACTORS if extractors is None else extractors
    calls = {k: x.from_bytes for k, x in own.items() if x.from_bytes is not None}

    def one(name: str | None, data: bytes | None) -> tuple[list[dict] | None, str | None]:
        if name is None:
            return None, None
        try:
            return [{f: u.get(f) for f in _FIELDS} for u in calls[name](bytes(data or b""))], None
        except Refused as refused:
            return None, str(refused)
        except Exception:  # a file's fault, whatever it is, is told in its row
            return None, "extraction_failed"

    @F.pandas_udf(f"struct<units:array<{UNIT}>,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            yield pd.DataFrame([one(n, c) for n, c in zip(names, contents, strict=True)], columns=["units", "error"])

    go = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    called = go & F.col(kind).isin(list(calls))
    out = docs.withColumn("_told", run(F.when(called, F.col(kind)), F.when(called, F.col(content))))
    found = F.when(called, F.col("_told.units"))
    for k, x in own.items():
        if x.from_column is not None:
            found = F.when(go & (F.col(kind) == k), x.from_column(F.coalesce(F.col(content).cast("string"), F.lit("")))).otherwise(found)
    known = F.coalesce(F.col(kind).isin(list(own)), F.lit(False))
    return out.withColumn("units", found).withColumn("extract_error", F.when(go, F.when(~known, "no_extractor").otherwise(F.col("_told.error")))).drop("_told")


def validated(docs: DataFrame, extractors: dict[str, Extractor] | None = None, most_bytes: int = 15 * files.MEGABYTE) -> DataFrame:
    """docs (filename, content, mime_type) with kind and invalid, the first rule that a file breaks before it is read.

    In order: no content (no_text), the rules of an upload, a name that its first bytes deny, bytes that are no text,
    bytes that aren't UTF-8 where that is asked for.
    """
    own = EXTRACTORS if extractors is None else extractors
    kind, content = files.kind(F.col("filename")), F.col("content")
    upload = files.validate_upload(F.col("filename"), F.octet_length(content), F.col("mime_type"), most_bytes)["error"]
    textual = ~F.coalesce(kind.isin(list(files.MAGIC)), F.lit(False))
    strict = kind.isin([k for k, x in own.items() if x.strict])
    invalid = (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "no_text")
        .when(upload.isNotNull(), upload)
        .when(files.content_mismatch(content, F.col("filename")), "content_mismatch")
        .when(textual & looks_binary(content), "binary_content")
        .when(strict & ~F.is_valid_utf8(content.cast("string")), "invalid_utf8")
    )
    return docs.withColumn("kind", kind).withColumn("invalid", invalid)


def judged(docs: DataFrame, extractors: dict[str, Extractor] | None = None, characters: int = quality.MOST_CHARACTERS, most_units: int = quality.MOST_UNITS) -> DataFrame:
    """docs (kind, invalid, units, extract_error) with n_units, char_count, word_count, failed_stage and error, both null for a document that may go on."""
    own = EXTRACTORS if extractors is None else extractors
    plain = F.trim(F.regexp_replace(F.array_join(F.transform("units", lambda u: u["text"]), " "), r"\s+", " "))
    counted = docs.withColumn("_plain", F.coalesce(plain, F.lit("")))
    counted = counted.withColumn("n_units", F.coalesce(F.size("units"), F.lit(0))).withColumn("char_count", F.length("_plain").cast("long"))
    counted = counted.withColumn("word_count", F.when(F.col("_plain") == "", 0).otherwise(F.regexp_count("_plain", F.lit(" ")) + 1).cast("long")).drop("_plain")
    per = lambda of: F.create_map(*[F.lit(x) for k, v in own.items() for x in (k, of(v))])[F.col("kind")]
    few = (F.col("char_count") < per(lambda v: v.least[0])) | (F.col("word_count") < per(lambda v: v.least[1]))
    error = (
        F.when(F.col("invalid").isNotNull(), F.struct(F.lit("validating").alias("stage"), F.col("invalid").alias("error")))
        .when(F.col("extract_error") == "no_extractor", F.struct(F.lit("validating").alias("stage"), F.lit("no_extractor").alias("error")))
        .when(F.col("extract_error").isNotNull(), F.struct(F.lit("extracting").alias("stage"), F.col("extract_error").alias("error")))
        .when(F.col("char_count") == 0, F.struct(per(lambda v: v.stage).alias("stage"), F.lit("no_text").alias("error")))
        .when(few, F.struct(per(lambda v: v.stage).alias("stage"), F.lit("not_enough_content").alias("error")))
        .when(F.col("char_count") > characters, F.struct(F.lit("extracting").alias("stage"), F.lit("too_many_characters").alias("error")))
        .when(F.col("n_units") > most_units, F.struct(F.lit("extracting").alias("stage"), F.lit("too_many_units").alias("error")))
    )
    return counted.withColumn("_error", error).withColumn("failed_stage", F.col("_error.stage")).withColumn("error", F.col("_error.error")).drop("_error")
