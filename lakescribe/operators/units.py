"""Documents cut into typed units with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import collapse, count_words
from . import numbering

LINES, PARAGRAPHS, ROWS, MOST_UNITS = 80, 12, 8, 150
HEADING_LEVELS = 6


def _groups(values: Column, size: int) -> Column:
    """An array's items in arrays of size, without a shuffle."""
    last = F.greatest(F.ceil(F.size(values) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, size))


def from_text(docs: DataFrame, keys: list[str], text: str = "text", lines_per_unit: int = LINES) -> DataFrame:
    """keys, unit_index, text, line_start, line_end of every lines_per_unit lines; blank units are left out."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    cut = docs.where(F.col(text).isNotNull()).select(*keys, F.size(lines).alias("_n"), F.posexplode(_groups(lines, lines_per_unit)).alias("_group", "_lines"))
    units = cut.select(
        *keys,
        F.col("_group").alias("unit_index"),
        F.trim(F.array_join("_lines", "\n")).alias("text"),
        (F.col("_group") * lines_per_unit + 1).alias("line_start"),
        F.least((F.col("_group") + 1) * lines_per_unit, F.col("_n")).alias("line_end"),
    )
    return units.where(collapse(F.col("text")) != "")


def from_paragraphs(docs: DataFrame, keys: list[str], text: str = "text", per_unit: int = PARAGRAPHS) -> DataFrame:
    """keys, unit_index, text, paragraph_start, paragraph_end; paragraphs are parted by blank lines."""
    parts = F.filter(F.transform(F.split(F.col(text), "\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    cut = docs.where(F.size(parts) > 0).select(*keys, F.size(parts).alias("_n"), F.posexplode(_groups(parts, per_unit)).alias("unit_index", "_p"))
    return cut.select(
        *keys,
        "unit_index",
        F.array_join("_p", "\n\n").alias("text"),
        (F.col("unit_index") * per_unit + 1).alias("paragraph_start"),
        F.least((F.col("unit_index") + 1) * per_unit, F.col("_n")).alias("paragraph_end"),
    )


def table_units(rows: DataFrame, keys: list[str], order: list[str], headers: list[str], style: str = "csv", per_unit: int = ROWS, most: int = MOST_UNITS, first_row: int = 2, in_task: int = numbering.IN_TASK) -> DataFrame:
    """keys, unit_index, row_start, row_end, text: per_unit rows of a table, more if it would take over most units.

    csv: "Row n: header: value; ..."; sheet: "Row n: header=value | ...". A blank value is [blank], a blank header
    Column i. Rows are numbered by order within keys, from first_row; tables of more than in_task rows by ranges.
    """
    between, parts = (": ", "; ") if style == "csv" else ("=", " | ")
    cells = []
    for k, name in enumerate(headers):
        value = F.trim(F.col(name).cast("string"))
        cells.append(F.concat(F.lit((name.strip() or f"Column {k + 1}") + between), F.when(value.isNull() | (value == ""), "[blank]").otherwise(value)))
    by = [f"_o{k}" for k in range(len(order))]
    said = rows.select(*keys, F.concat_ws(parts, *cells).alias("_cells"), *[F.col(o).alias(n) for o, n in zip(order, by, strict=True)])
    numbered = numbering.row_numbers(said, keys, by, "_r", "_n", in_task)
    size = F.when(F.ceil(F.col("_n") / per_unit) > most, F.ceil(F.col("_n") / most)).otherwise(F.lit(per_unit))
    placed = numbered.select(*keys, F.floor((F.col("_r") - 1) / size).cast("int").alias("unit_index"), (F.col("_r") + (first_row - 1)).cast("int").alias("_row"), "_cells")
    text = F.transform(F.sort_array(F.collect_list(F.struct("_row", "_cells"))), lambda x: F.concat(F.lit("Row "), x["_row"].cast("string"), F.lit(": "), x["_cells"]))
    return placed.groupBy(*keys, "unit_index").agg(F.min("_row").alias("row_start"), F.max("_row").alias("row_end"), F.array_join(text, "\n").alias("text"))


def heading_path(blocks: DataFrame, keys: list[str], order: str, level: str = "level", text: str = "text", in_task: int = numbering.IN_TASK) -> DataFrame:
    """blocks with heading_path: the headings above each block. level: 1 to 6 for a heading, null for other blocks.

    A heading ends all of its own level and below, so of each level the last heading counts unless a higher one came since.
    The last of each level is a running maximum by order, so documents of more than in_task blocks are worked on by
    ranges, each with the headings that were open before it.
    """
    h = fresh(blocks, *[f"h{k}" for k in range(1, HEADING_LEVELS + 1)])
    values = {h[k]: F.when(F.col(level) == k + 1, F.struct(F.col(order).alias("at"), F.col(text).alias("text"))) for k in range(HEADING_LEVELS)}
    out = numbering.running(blocks, keys, order, values, F.max, in_task)
    higher = lambda k: F.greatest(F.lit(None), F.lit(None), *[F.col(f"{h[j]}.at") for j in range(k)])
    live = [F.when(F.coalesce(F.col(f"{h[k]}.at") > higher(k), F.col(h[k]).isNotNull()), F.col(f"{h[k]}.text")) for k in range(HEADING_LEVELS)]
    return out.withColumn("heading_path", F.array_compact(F.array(*live))).drop(*h)


def document_stats(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_units, char_count, word_count."""
    one = units.select(*keys, F.length(text).cast("long").alias("_c"), count_words(F.col(text)).cast("long").alias("_w"))
    return one.groupBy(*keys).agg(F.count("*").alias("n_units"), F.sum("_c").alias("char_count"), F.sum("_w").alias("word_count"))
