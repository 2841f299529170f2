"""CSV texts of any size.

A quote turns quoting on or off wherever it stands, so a place is within quotes if the number of quotes before it is odd,
and a row ends at a line end with an even number before it. Counting is all it takes to cut a huge text at row ends; the
pieces are read by other tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a piece; a text of no more is read where it stands.
PIECE = 4_000_000
_SEPARATOR = re.compile(r"(,|\r\n?|\n)")
_END = re.compile(r'"|\r\n?|\n')


def read_rows(text: str) -> list[list[str]]:
    """Rows of trimmed cells; rows without a filled cell are left out. Two quotes within quotes are a quote; any line end ends a row."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    parts = text.removeprefix("﻿").split('"')
    for k, part in enumerate(parts):
        if k % 2:  # within quotes
            field.append(part)
        elif part:
            first, *rest = _SEPARATOR.split(part)
            field.append(first)
            for separator, after in zip(rest[::2], rest[1::2], strict=True):
                row.append("".join(field).strip())
                field = [after]
                if separator != ",":
                    if any(row):
                        rows.append(row)
                    row = []
        elif 0 < k < len(parts) - 1:
            field.append('"')
    row.append("".join(field).strip())
    return [*rows, row] if any(row) else rows


def row_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces that end where a row does, of about size characters, or as long as the row that stands there."""
    start = 0
    while len(text) - start > size:
        at, quoted = start + size, text.count('"', start, start + size) % 2 == 1
        if text[at - 1] == "\r" and text[at] == "\n":
            at += 1
        while (m := _END.search(text, at)) is not None:
            at = m.end()
            if m[0] == '"':
                quoted = not quoted
                if quoted:  # nothing ends before the next quote
                    close = text.find('"', at)
                    if close < 0:
                        m = None
                        break
                    at, quoted = close + 1, False
            elif not quoted:
                break
            else:
                close = text.find('"', at)
                if close < 0:
                    m = None
                    break
                at, quoted = close + 1, False
        if m is None:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def parse_csv(docs: DataFrame, keys: list[str], column: str = "text", piece: int = PIECE) -> DataFrame:
    """keys, row_index, cells (array of string): quoted and doubled quotes, any line ends, trimmed cells, blank rows left out.

    Texts of more than piece characters are cut at row ends, and the pieces dealt out to be read; they are read twice, first
    to count the rows that come before each. keys must tell such texts apart. Null texts have no rows.
    """

    @F.pandas_udf("array<array<string>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda x: None if x is None else read_rows(x))

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda x: None if x is None else list(row_pieces(x, piece)))

    long = F.length(column) > piece
    short = docs.where(~long).select(*keys, F.posexplode(parsed(F.col(column))).alias("row_index", "cells"))
    pieces = docs.where(long).select(*keys, F.posexplode(cut(F.col(column))).alias("_piece", "_body"))
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    read = pieces.repartition(4 * parallel, *keys, "_piece").select(*keys, "_piece", parsed(F.concat(F.when(F.col("_piece") > 0, "\n").otherwise(""), "_body")).alias("_rows"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = read.select(*keys, "_piece", F.size("_rows").alias("_n")).select(*keys, "_piece", before.cast("int").alias("_before"))  # a row a piece
    numbered = read.join(counts, [*keys, "_piece"]).select(*keys, "_before", F.posexplode("_rows").alias("_k", "cells"))
    return short.unionByName(numbered.select(*keys, (F.col("_before") + F.col("_k")).alias("row_index"), "cells"))
