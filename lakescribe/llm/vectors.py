"""Vectors of whole numbers, packed: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers of this size or more can't be packed, and their products' sums would not fit a long.
TOO_LARGE = 2.0**28


def common_width(df: DataFrame, vector_col: str) -> int:
    """The commonest number of entries, of equals the least; 0 for a table without vectors."""
    sizes = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("width")).count()
    row = sizes.orderBy(F.desc("count"), "width").first()
    return row["width"] if row else 0


def floored(batch: pa.RecordBatch, vector_col: str, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have width finite entries, and floor(scale * entry) of those rows, of which any of TOO_LARGE leaves its row out."""
    column = batch.column(vector_col)
    right = np.asarray(column.is_valid()) & np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    column = column.filter(pa.array(right))
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan)).reshape(len(column), width)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(scale * flat)
        fine = (np.abs(whole) < TOO_LARGE).all(1) if width else np.zeros(len(column), bool)  # false for NaN
    kept = np.flatnonzero(right)[fine]
    return kept, whole[fine].astype("<i4")


def packed(whole: np.ndarray) -> pa.Array:
    """One binary value a row."""
    n, size = len(whole), whole.shape[1] * whole.itemsize if whole.ndim == 2 else 0
    if n == 0:
        return pa.array([], pa.binary())
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(whole).tobytes())])


def unpacked(column: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    """What packed() took, as a matrix."""
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", kind, len(column) * width, column.offset * size).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def packed_rows(df: DataFrame, vector_col: str, width: int, scale: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and x, the packed floor(scale * entry), of rows that floored() leaves in; no shuffle."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            kept, whole = floored(batch, vector_col, width, scale)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in carried), packed(whole)], [*carried, "x"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carried).schema.fields]
    return df.select(*carried, vector_col).mapInArrow(batches, ", ".join([*fields, "x binary"]))
