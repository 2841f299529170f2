"""Media columns: bytes stored as lossless WebP images in a binary column, read back to pixel arrays, and their features.

A text's UTF-8 bytes, filled up with bytes 255 to whole units, are the samples of a grey image, WIDTH to a row. An image
has ROWS rows at most, so that a reader's memory is bounded; a longer payload is several files, one after another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp
from .common import table

#: Samples in a row, and rows of an image.
WIDTH, ROWS = 192, 3072
#: A payload is a positive multiple of so many bytes.
UNIT = 3 * WIDTH


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\xff")


def image_of(samples: np.ndarray) -> bytes:
    """A grey image (height, width) as a lossless WebP file with back-references, of three ways by the shortest.

    Every image is tried through the palette, through predictor and cross-colour, and with a colour cache. A way's exact size
    is known before it is written, and a way whose symbols' entropy alone takes more than the shortest so far can't be it.
    """
    shades = int(np.count_nonzero(np.bincount(samples.ravel(), minlength=256)))
    best = webp.shades_way(samples)
    for way in (webp.grey_way, lambda x: webp.cache_way(x, max(1, shades.bit_length()))):
        other = way(samples)
        if other.under(webp.file_size(best.size)):
            best = other
    return webp.riff(best.stream())


def to_media(payload: bytes) -> bytes:
    """The payload's bytes as the samples of grey images."""
    whole = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(image_of(whole[k : k + ROWS]) for k in range(0, len(whole), ROWS))


def read_media(media: bytes) -> Iterator[np.ndarray]:
    """The pixels (height, width, 4) of each image of a value of a media column, from any lossless WebP files."""
    at = 0
    while at < len(media):
        stream, at = webp.chunk_of(media, at)
        yield webp.decode_stream(stream)


def samples_of(images: list[np.ndarray]) -> bytes:
    """What grey images hold."""
    return b"".join(np.ascontiguousarray(x[..., 1]).tobytes() for x in images)


def feature(images: list[np.ndarray]) -> str:
    """Height and width, the samples' mean and deviation, and which 64ths of them are brighter than the mean."""
    rows = sum(len(x) for x in images)
    flat = np.frombuffer(samples_of(images), np.uint8).astype(np.int64)
    starts = np.arange(64) * len(flat) // 64
    cells = np.add.reduceat(flat, starts) / np.diff(np.append(starts, len(flat)))
    mark = int(np.packbits(cells > flat.mean()).view(">u8")[0])
    return f"{rows}x{images[0].shape[1]};{flat.mean():.3f},{flat.std():.3f};{mark:016x}"


@F.pandas_udf(T.BinaryType())
def webp_column(texts: pd.Series) -> pd.Series:
    """The media of each text; a null text is stored like an empty one."""
    return pd.Series([to_media(payload_of(x)) for x in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType().add("height", "integer").add("width", "integer").add("rgba", "binary")))
def pixel_column(media: pd.Series) -> pd.Series:
    """The images of each value of a media column, from any lossless WebP files; null for null."""
    return pd.Series([None if x is None else [(p.shape[0], p.shape[1], p.tobytes()) for p in read_media(x)] for x in media], dtype=object)


@F.pandas_udf(
    T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")
)
def digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    for stored in media:
        images = list(read_media(stored))
        payload = samples_of(images)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(images)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes as lossless WebP.

    Null text counts as empty: one row of pixels, all 255. Null ids stay null, repeated rows are each stored and equal
    texts have equal media; other columns are dropped whatever their names; an empty table gives an empty one.
    """
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), webp_column(text).alias("media"))


def describe(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) read back: what the pixels hold, in place of the media. No shuffle."""
    return stored.select("doc_id", "n_bytes", digest("media").alias("x")).select("doc_id", "n_bytes", "x.*")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents")))
