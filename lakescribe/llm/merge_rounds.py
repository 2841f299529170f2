"""SentencePiece BPE by rounds of merges over flat arrays.

The symbols of many words stand in one numpy array. In a round each word's least pair rank is found (a minimum over its
segment), all its pairs of that rank merge at once, leftmost first where they overlap, and the array is compacted; words
that have no pair left leave it. That gives what merging one pair after the other gives, as long as a merge can't bring
a pair of the same or a lower rank; where it can (the vocabulary says for which pieces), a word merges its leftmost pair only.
In words of over LONG_WORD symbols a round would touch the whole word for each of its ranks: these merge pair by pair from a heap.

A text is cut into words where no merge can join what stands on both sides: before white space, and around characters
that are in no piece of two characters or more. Each distinct word is encoded once and kept in a bounded store.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
STORED_WORDS, BLOCK, LONG_WORD = 600_000, 1 << 20, 256
NONE = np.int32(2**31 - 1)

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A model's vocabulary as arrays: which symbols make which, in which order; and its bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces
        kinds = {x.type for x in model.pieces}
        if not plain or model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix, no other normalisation and no pieces of the user's are encoded here")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.size = self.library.eos_id(), len(model.pieces)
        names = {x.piece: k for k, x in enumerate(model.pieces) if x.type == kind.NORMAL}
        #: Pieces of equal score have equal rank.
        rank = np.unique([-x.score for x in model.pieces], return_inverse=True)[1].astype(np.int32)
        long = [x for x in names if len(x) > 1]
        #: Symbols: the pieces, then characters that only longer pieces hold, then one for all characters of no piece.
        lone = sorted({c for x in long for c in x} - set(names))
        symbol = names | {c: self.size + k for k, c in enumerate(lone)}
        self.unknown = self.size + len(lone)
        self.width = self.unknown + 1
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        made: dict[int, int] = {}
        best = np.full(self.width, NONE, np.int32)  # the least rank of what a symbol can be one side of
        for x in long:
            t = names[x]
            for cut in range(1, len(x)):
                a, b = symbol.get(x[:cut]), symbol.get(x[cut:])
                if a is not None and b is not None:
                    made[a * self.width + b] = t
                    best[[a, b]] = np.minimum(best[[a, b]], rank[t])
        self.pairs = np.array(sorted(made), np.int64)
        self.makes = np.array([made[k] for k in self.pairs.tolist()], np.int32)
        self.makes_rank, self.made, self.rank = rank[self.makes], made, rank.tolist()
        #: After this piece is made, other pairs of the word wait for what it may bring.
        self.alone = np.zeros(self.width, bool)
        self.alone[: self.size] = best[: self.size] <= rank
        #: Characters of pieces of two or more; all others stand alone.
        inner = sorted({c for x in long for c in x} - {SPACE})
        members = "".join(map(re.escape, inner))
        self.words = re.compile(f"{SPACE}*[{members}]+|{SPACE}+|[^{SPACE}]", re.DOTALL)
        bytes_of = {int(x.piece[3:5], 16): k for k, x in enumerate(model.pieces) if x.type == kind.BYTE}
        self.byte_ids = [bytes_of[k] for k in range(256)]
        self.bytes = [x.piece.replace(SPACE, " ").encode() if x.type == kind.NORMAL else b"" for x in model.pieces]
        for value, k in bytes_of.items():
            self.bytes[k] = bytes([value])
        self.bytes[self.library.unk_id()] = (model.trainer_spec.unk_surface or " ⁇ ").encode()

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of symbols the rank and the symbol it makes; rank NONE where it makes none."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        found = self.pairs[at] == keys
        return np.where(found, self.makes_rank[at], NONE), self.makes[at]

    def one_by_one(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The symbols left of one word and where they start, merged pair by pair: least rank first, then leftmost."""
        n, made, rank, width = len(symbols), self.made, self.rank, self.width
        after, before, now = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                t = made.get(now[i] * width + now[after[i]])
                if t is not None:
                    heapq.heappush(heap, (rank[t], i, after[i], now[i], now[after[i]], t))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b, t = heapq.heappop(heap)
            if now[i] != a or after[i] != j or now[j] != b:
                continue
            now[i], now[j] = t, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        starts = [i for i in range(n) if now[i] >= 0]
        return [now[i] for i in starts], starts

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of all words, whose symbols stand one after the other, and where each starts; by rounds."""
        start = np.arange(len(symbols))
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, makes = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        fresh = np.arange(len(symbols))  # pairs to look up: i is the one of i and i + 1
        while len(symbols):
            same = fresh[fresh < len(symbols) - 1]
            same = same[word[same] == word[same + 1]]
            rank[fresh] = NONE
            rank[same], makes[same] = self.looked_up(symbols[same], symbols[same + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            live = least < NONE
            if not live.all():
                done.append((start[~live], symbols[~live]))
                symbols, start, word, rank, makes, least = (x[live] for x in (symbols, start, word, rank, makes, least))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            run = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]  # overlapping pairs in a row
            begins = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            chosen = (np.arange(len(at)) - begins) % 2 == 0
            if (waits := self.alone[makes[at]]).any():
                leftmost = np.r_[True, word[at[1:]] != word[at[:-1]]]
                slow = np.isin(word[at], word[at[waits]])
                chosen = np.where(slow, leftmost, chosen)
            at = at[chosen]
            symbols[at] = makes[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            new = np.cumsum(stays) - 1
            symbols, start, word, rank, makes = (x[stays] for x in (symbols, start, word, rank, makes))
            at = new[at]
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
        starts, left = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, int) for k in (0, 1))
        order = np.argsort(starts, kind="stable")
        return left[order], starts[order]


class Encoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers. Emptied when it holds STORED_WORDS, so memory is bounded."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces = Pieces(path)
        self.end = np.array([self.pieces.end], "<u4").tobytes()
        self.shown = [str(k) for k in range(self.pieces.size)]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that aren't stored, all in the same rounds."""
        p, new = self.pieces, [x for x in words if x not in self]
        for x in [x for x in new if len(x) > LONG_WORD]:
            symbols, starts = p.one_by_one(p.of_char[np.frombuffer(x.encode("utf-32-le"), "<u4")].tolist())
            self[x] = self._ids(x, symbols, starts)
        new = [x for x in new if len(x) <= LONG_WORD]
        if not new:
            return
        joined, lengths = "".join(new), np.array(list(map(len, new)))
        left, starts = p.merged(p.of_char[np.frombuffer(joined.encode("utf-32-le"), "<u4")], lengths)
        ends = np.cumsum(lengths)
        cuts = np.searchsorted(starts, np.r_[0, ends])
        plain, packed = np.maximum.reduceat(left, cuts[:-1]) < p.size, left.astype("<u4").tobytes()
        cuts, begins = cuts.tolist(), (ends - lengths).tolist()
        for k, x in enumerate(new):
            a, b = cuts[k], cuts[k + 1]
            self[x] = packed[4 * a : 4 * b] if plain[k] else self._ids(x, left[a:b].tolist(), (starts[a:b] - begins[k]).tolist())

    def _ids(self, word: str, symbols: list[int], starts: list[int]) -> bytes:
        """Ids of the symbols; characters that are no piece become pieces of their bytes."""
        p, ids = self.pieces, []
        for s, at in zip(symbols, starts, strict=True):
            ids += [s] if s < p.size else [p.byte_ids[b] for b in word[at].encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids and the end id, 4 bytes each; texts are taken in blocks of about BLOCK characters."""
        block, size = [], 0
        for text in texts:
            block.append(self.pieces.words.findall(SPACE + text.replace(" ", SPACE)) if text else [])
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        if len(self) >= STORED_WORDS:
            self.clear()
        words = set().union(*block)
        self.learn(words)
        for found in block:
            yield b"".join(map(self.__getitem__, found)) + self.end
        for x in [x for x in words if len(x) >= 64]:
            del self[x]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: the first piece that says something loses the prefix; bytes that aren't UTF-8 become U+FFFD one by one."""
        said = [self.pieces.bytes[k] for k in ids]
        first = next((k for k, x in enumerate(said) if x), None)
        if first is not None and said[first][:1] == b" " and ids[first] != self.pieces.byte_ids[32] and ids[first] != self.pieces.library.unk_id():
            said[first] = said[first][1:]
        if b"" not in said[:-1]:
            return b"".join(said).decode("utf-8", "each-byte")
        # control pieces say nothing, but bytes on both sides of one make no character
        return "".join(b"".join(run).decode("utf-8", "each-byte") for says, run in itertools.groupby(said, bool) if says)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of each whole text, the end id last. Null text counts as empty: the end id alone.

    A null id stays null; repeated rows are each encoded; other columns are dropped; an empty table gives an empty one.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<i4") for x in own.encode(texts)], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the text of its ids in a new column decoded; null ids give null, no ids an empty text, an empty table an empty one."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for rows in batches:
            yield pd.Series([None if x is None else own.decode(list(x)) for x in rows], dtype=object)

    return encoded.withColumn("decoded", decoded(ids_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, decoded and hashed where the row is read, no shuffle.

    Null text counts as empty: the end id alone, and the hash of no text. A null id stays null; repeated rows are each
    treated; other columns are dropped; an empty table gives an empty one. A text's memory is some times its length.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        shown = own.shown.__getitem__
        for texts in batches:
            rows = []
            for packed in own.encode(texts):
                ids = np.frombuffer(packed, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("doc_id", "x.*")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return round_trip(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
