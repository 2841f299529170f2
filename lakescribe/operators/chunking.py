"""Overlapping windows of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORDS_PER_TOKEN, estimate_tokens, words

TARGET, OVERLAP, MOST = 500, 50, 200
#: What a chunk's metadata keeps of its unit.
PROVENANCE = ("block_type", "code_language", "cell_index", "heading_path", "line_end", "line_start", "location_label", "page_number", "row_end", "row_start", "sheet_name", "source_location", "table_context", "title", "extraction_method", "warnings", "char_count", "word_count")


def window_sizes(target: int = TARGET, overlap: int = OVERLAP) -> tuple[int, int]:
    """Words of a window, and from one window's start to the next's."""
    size = max(1, math.floor(target / WORDS_PER_TOKEN))
    return size, max(1, size - math.floor(overlap / WORDS_PER_TOKEN))


def windows(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The windows' texts: one for a text that fits, else until one reaches the end; none for a blank text."""
    size, step = window_sizes(target, overlap)

    def of(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words(text)), of), 1)  # the words are split once: a lambda over an array of one binds them


def chunk_documents(docs: DataFrame, keys: list[str], text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """keys, chunk_index, content of each document of one text. No shuffle: a text is cut where it is read."""
    return docs.select(*keys, F.posexplode(windows(F.col(text), target, overlap)).alias("chunk_index", "content"))


def chunk_units(units: DataFrame, keys: list[str], order: str = "unit_index", text: str = "text", is_row: str | None = None, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """Chunks of documents that come as units: units' columns, chunk_part, content, chunk_index, n_chunks, failed.

    A unit where is_row holds is one chunk however long. chunk_index counts through a document; a document of more than
    most chunks has failed, and all its chunks say so.
    """
    whole = F.col(is_row) if is_row else F.lit(False)
    parts = units.select("*", F.posexplode(F.when(whole, F.array(F.trim(F.col(text)))).otherwise(windows(F.col(text), target, overlap))).alias("chunk_part", "content"))
    parts = parts.where(F.col("content") != "")
    by = Window.partitionBy(*keys)
    return parts.select(
        "*",
        (F.row_number().over(by.orderBy(order, "chunk_part")) - 1).alias("chunk_index"),
        F.count("*").over(by).alias("n_chunks"),
        (F.count("*").over(by) > most).alias("failed"),
    )


def chunk_pages(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text", most: int = MOST, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """As chunk_units, but a document's chunks beyond most are left out."""
    cut = chunk_units(pages, keys, page, text, None, target, overlap, most)
    return cut.where(F.col("chunk_index") < most).drop("failed", "n_chunks")


def with_metadata(chunks: DataFrame, provenance: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """chunks with estimated_tokens and a map metadata of what is known of their units."""
    known = [c for c in (*provenance, "chunk_part", "document_id", "filename") if c in chunks.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), (F.to_json(c) if dict(chunks.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias("value")) for c in known])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return chunks.select("*", estimate_tokens(F.col("content")).alias("estimated_tokens"), F.map_from_entries(present).alias("metadata"))
