"""Byte-level BPE by prefix dynamic programming.

Of all tokens that could end a byte prefix exactly one does in the BPE encoding of that prefix. A table keeps it for each
prefix: a token t that ends at byte i is the one if it and the last token of the prefix before t stay apart when their
bytes are merged by rank. So bytes can be appended without looking at the table again, a text is encoded by walking back
from its end, and after an edit the table is recomputed from the edit to the place where it repeats the old one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordpieces import OTHER_CHARACTERS

STORED_PIECES, STORED_PAIRS, BLOCK = 600_000, 1_000_000, 1 << 20
NEVER = 1 << 62


class Ranks:
    """A vocabulary of byte strings by rank, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for x, k in ranks.items():
            self.token[k] = x
        #: Every end of a token -> its id, or -1 where that end isn't a token itself.
        self.endings = {x[i:]: -1 for x in ranks for i in range(len(x))} | ranks
        self.longest = max(map(len, ranks))
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: dict[int, tuple[list, list]] = {}

    def spines(self, t: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts at token t's left and right edge while its bytes are merged, each with the rank that ends it."""
        if t not in self._spines:
            parts = [bytes([x]) for x in self.token[t]]
            left, right = [], []
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], NEVER))
                r = self.rank.get(parts[best] + parts[best + 1], NEVER)
                if r == NEVER:
                    raise ValueError(f"token {t} can't be merged from bytes")
                if best == 0:
                    left.append((parts[0], r))
                if best == len(parts) - 2:
                    right.append((parts[-1], r))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            left.append((parts[0], NEVER))
            right.append((parts[0], NEVER))
            self._spines[t] = left, right
        return self._spines[t]

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged by rank, give a and b again: no merge across the border comes first."""
        known = self._apart.get((a, b))
        if known is None:
            (right, left), i, j, known = (self.spines(a)[1], self.spines(b)[0]), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = right[i], left[j]
                across = self.rank.get(x + y, NEVER)
                if across < x_ends and across <= y_ends and across != NEVER:  # of equal ranks the leftmost merges first
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self._apart) >= STORED_PAIRS:
                self._apart.clear()
            self._apart[a, b] = known
        return known


class PrefixTable:
    """The last token of each prefix of the bytes so far."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """More bytes at the end: the entries so far stay as they are."""
        self.data += more
        self._extend(len(self.data), [], 0)

    def truncate(self, n: int) -> None:
        """Back to the first n bytes."""
        self.data = self.data[:n]
        del self.last[n + 1 :]

    def _extend(self, end: int, old: list[int], at: int) -> bool:
        """Entries up to the prefix of end bytes; stops, true, where they repeat old (that starts at entry at + 1) for as long as a token can be."""
        data, last, run, pairs = self.data, self.last, 0, self.ranks._apart
        endings, longest, apart = self.ranks.endings.get, self.ranks.longest, self.ranks.apart
        for i in range(len(last), end + 1):
            found, k = [], i - 1
            least = i - longest if i > longest else 0
            t = endings(data[k:i])
            while t is not None:
                if t >= 0:
                    found.append((k, t))
                k -= 1
                if k < least:
                    break
                t = endings(data[k:i])
            for k, t in reversed(found):
                if k == 0:
                    break
                pair = (last[k], t)
                if pairs[pair] if pair in pairs else apart(*pair):
                    break
            else:
                raise ValueError("no token ends this prefix: the vocabulary lacks a byte")
            last.append(t)
            if old:
                run = run + 1 if t == old[i - at - 1] else 0
                if run >= longest:
                    return True
        return False

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in the place of bytes start to end; returns how many entries were computed anew."""
        tail, old = self.data[end:], self.last[end + 1 :]
        self.truncate(start)
        self.append(new)
        at = len(self.data)
        self.data += tail
        if old and self._extend(len(self.data), old, at):  # every later entry looks back at equal ones only
            done = len(self.last) - 1
            self.last += old[done - at :]
            return done - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, i, last, token = [], len(self.data), self.last, self.ranks.token
        while i:
            t = last[i]
            out.append(t)
            i -= len(token[t])
        return out[::-1]


_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: The pattern with the classes' members among the plain Latin characters.
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"


class Codec(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; a bounded store of pieces already encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers

        super().__init__()
        self.ranks, self.any = Ranks(ranks), regex.compile(pattern)
        self.latin = re.compile(LATIN_PATTERN) if pattern == public_tokenizers.PATTERN else None

    def __missing__(self, piece: str) -> bytes:
        return np.asarray(PrefixTable(self.ranks, piece.encode()).ids(), "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        return (self.latin if self.latin and not OTHER_CHARACTERS.search(text) else self.any).findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encodes what isn't stored, in order, so that each piece keeps the table of the prefix it shares with the last."""
        if len(self) >= STORED_PIECES:
            self.clear()
        table = PrefixTable(self.ranks)
        for data, piece in sorted((x.encode(), x) for x in pieces if x not in self and len(x) < 64):
            whole = self.ranks.rank.get(data)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
                continue
            same = 0
            for x, y in zip(table.data, data, strict=False):
                if x != y:
                    break
                same += 1
            table.truncate(same)
            table.append(data[same:])
            ids = table.ids()
            self[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids; texts are taken in blocks of about BLOCK characters."""
        block, size = [], 0
        for text in texts:
            block.append(self.pieces(text))
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        self.learn(set().union(*block))
        for pieces in block:
            yield b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker process and file."""
    return Codec(read_ranks(path), pattern)


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): each whole text's tokens. Null text counts as empty; repeated rows are each encoded."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<i4") for x in own.encode(texts)], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the bytes of its ids in a new column decoded; null ids give null."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for rows in batches:
            yield pd.Series([None if x is None else own.decode(np.asarray(x, "<u4").tobytes()) for x in rows], dtype=object)

    return encoded.withColumn("decoded", decoded(ids_col))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, decoded and hashed where the row is read.

    Null text counts as empty: no ids, both hashes those of no bytes. A null id stays null; repeated rows are each
    treated; other columns are dropped; an empty table gives an empty one. A text's memory is a few times its length.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in batches:
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()) for x in own.encode(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("doc_id", "x.*")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
