"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where they provably agree.

A chunk may start inside a word, so its first tokens can be wrong, and it may end inside one, so its last can be. Both
chunks' encodings carry offsets. A place p in the overlap is a proven stable boundary when

* a match of the pre-tokenizer starts at p in both encodings: matching has no memory, so from p on the right chunk's
  matches are those of the whole text;
* p lies LOOKAHEAD or more before the left chunk's end, so each of the left chunk's matches that ends by p was ended by
  a character the chunk holds, and not by its edge;
* the character at p can't compose with the one before it (NFC), so both sides are normalised alike.

If an overlap has no such place, it is doubled; once it would cover all of the left chunk, whose start is a proven
boundary, the text from there is encoded anew with a chunk twice as long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordpieces import word_pieces

CHUNK, OVERLAP, LOOKAHEAD = 32_768, 256, 4
LIMIT = 2048


def starts_alone(text: str, p: int) -> bool:
    """No normal form joins the character at p to the one before it."""
    c = ord(text[p])
    plain = c < 0x300 or 0x4E00 <= c < 0xA000 or (text[p - 1].isspace() and c < 0x3000 and text[p].isalnum())
    return plain and len(text[p].lower()) == 1  # else one character can hold the ends and starts of matches


def _windows(encoding, at: int) -> tuple[list[int], dict[int, int]]:
    """The ids, and by place in the text the number of the token with which a match starts."""
    starts, last = {}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last:
            starts.setdefault(at + start, k)
            last = word
    return encoding.ids, starts


def spliced(encode: Callable, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Parts whose concatenation is encode(text).ids; at no time more than about two chunks are held."""
    n, lo, hi = len(text), 0, min(len(text), chunk)
    ids, starts = _windows(encode(text[:hi]), 0)
    base = 0  # the first id that isn't given out
    while hi < n:
        width = overlap
        while True:
            at = max(lo, hi - width)
            if at == lo:  # nothing agreed: lo is a proven boundary, so encode from there, twice as far
                hi = min(n, lo + 2 * (hi - lo))
                ids, starts = _windows(encode(text[lo:hi]), lo)
                base = 0
                break
            end = min(n, hi + chunk - overlap)
            right, right_starts = _windows(encode(text[at:end]), at)
            cut = next((p for p in sorted(right_starts, reverse=True) if at < p <= hi - LOOKAHEAD and p in starts and starts[p] >= base and starts_alone(text, p)), None)
            if cut is not None:
                yield ids[base : starts[cut]]
                ids, starts, base, lo, hi = right, right_starts, right_starts[cut], cut, end
                break
            width *= 2
    yield ids[base:]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row of docs, by the tokenizers file at path (on every machine).

    No shuffle: a row is counted where it is read. Null text counts as empty (0, 0, false). A null id stays null;
    repeated rows are each counted; other columns are dropped, whatever their names; an empty table gives an empty one.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        store = word_pieces(path)

        def encode(text: str):
            return store.library.encode(text, add_special_tokens=False)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if len(text) <= chunk or any(x in text for x in store.added):  # an added token may span a splice
                return len(store.packed(text)) // 4
            return sum(map(len, spliced(encode, text, chunk, overlap)))

        for texts in batches:
            yield pd.Series([count(x) for x in texts], dtype="int64")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return count_tokens(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
