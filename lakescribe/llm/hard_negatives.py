"""Hard negatives of embeddings by a secondary-sort shuffle.

Every row is scored against every anchor, in blocks: anchors fall into groups and rows into slots, both of bounded size and
by hash, each group meets each slot once, and a task reads a group's anchors and then streams the slot's rows by. What
leaves it is a packed key for each pair that can matter, (anchor, descending score, id): of a slot's rows of the anchor's
label the best few, and once the positives are known, of the others the best few in each positive's window.

Keys are shuffled by repartitionAndSortWithinPartitions, by anchor, so that a task reads an anchor's pairs from the best
score down. An iterator goes over them once: a positive opens its window of scores, a negative goes to each open window
that takes its score and isn't full. It holds an anchor's few windows, never its pairs.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .vectors import common_width, packed_rows, unpacked

SCALE = 256.0
#: An anchor's positives; negatives of each; the window 50 * p <= 100 * n <= 95 * p as numerators and denominator.
POSITIVES, NEGATIVES, WINDOW = 5, 3, (50, 95, 100)
#: Anchors a group and rows a slot at most, or about, as hashes divide them; rows a slot at least, where there are enough.
GROUP, SLOT, SMALL_SLOT = 32_768, 1 << 20, 4096
#: Anchors scored at once against a batch, and pairs held before they are pruned.
TILE, HELD = 256, 1 << 20

#: A key: id of the anchor, score turned round, id of the other row, all as they sort in bytes; then 1 for a positive.
KEY, KEY_SIZE = ">QQQB", 25
_KEYS = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("id", ">u8"), ("same", "u1")])
_SIGN = np.uint64(1 << 63)


def keys(anchor: np.ndarray, score: np.ndarray, other: np.ndarray, same: int) -> bytes:
    """Packed keys of int64 columns, one after the other."""
    out = np.empty(len(anchor), _KEYS)
    out["anchor"], out["id"], out["same"] = anchor.astype("i8").view("u8") ^ _SIGN, other.astype("i8").view("u8") ^ _SIGN, same
    out["score"] = ~(score.astype("i8").view("u8") ^ _SIGN)
    return out.tobytes()


def read_key(key: bytes) -> tuple[int, int, int, int]:
    """anchor, score, id, same of a packed key."""
    anchor, score, other, same = struct.unpack(KEY, key)
    return anchor - (1 << 63), (1 << 63) - 1 - score, other - (1 << 63), same


def sorted_by_score(pairs: RDD, partitions: int) -> RDD:
    """Keys of blobs of keys, each anchor's in one partition, from its best score down, equal ones by id."""
    return pairs.flatMap(_single).repartitionAndSortWithinPartitions(partitions, _by_anchor).keys()


def _single(blob: bytes) -> list[tuple[bytes, None]]:
    return [(blob[k : k + KEY_SIZE], None) for k in range(0, len(blob), KEY_SIZE)]


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def best(k: int, owner: np.ndarray, score: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k pairs of each owner with the best scores, of equal ones the least ids."""
    order = np.lexsort((other, -score, owner))
    owner, score, other = owner[order], score[order], other[order]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
    kept = place < k
    return owner[kept], score[kept], other[kept]


class Pruned:
    """Pairs (owner, score, id), pruned to each owner's best whenever more than HELD wait."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, owner: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if len(owner):
            self.parts.append(best(self.k, owner, score, other))
            self.size += len(self.parts[-1][0])
            if self.size > HELD and len(self.parts) > 1:
                self.parts = [self.all()]
                self.size = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        return best(self.k, *(np.concatenate([p[c] for p in self.parts]) for c in range(3)))


class Rows(NamedTuple):
    """Rows of a batch, or a group's anchors: ids, labels, whole numbers, and for anchors their positives' scores."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    windows: list[bytes]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def positives_of(anchors: Rows, batches: Iterator[Rows]) -> Iterator[bytes]:
    """Keys of each anchor's POSITIVES best rows among the batches with its label and another id."""
    found = Pruned(POSITIVES)
    by_label = np.argsort(anchors.labels, kind="stable")
    labels, begins = np.unique(anchors.labels[by_label], return_index=True)
    members = dict(zip(labels.tolist(), np.split(by_label, begins[1:]), strict=True))
    least = np.full(len(anchors.ids), np.iinfo(np.int64).min)  # what an anchor's pair must reach
    for rows in batches:
        order = np.argsort(rows.labels, kind="stable")
        labels, begins = np.unique(rows.labels[order], return_index=True)
        for label, at in zip(labels.tolist(), np.split(order, begins[1:]), strict=True):
            own = members.get(label, ())
            for k in range(0, len(own), TILE):
                mine = own[k : k + TILE]
                s = scores(anchors.x[mine], rows.x[at])
                s[anchors.ids[mine][:, None] == rows.ids[at]] = np.iinfo(np.int64).min
                if len(at) > POSITIVES:
                    least[mine] = np.maximum(least[mine], np.partition(s, len(at) - POSITIVES, axis=1)[:, len(at) - POSITIVES])
                i, j = np.nonzero((s >= least[mine][:, None]) & (s > np.iinfo(np.int64).min))
                found.add(mine[i], s[i, j], rows.ids[at][j])
    owner, score, other = found.all()
    yield from _blobs(anchors.ids[owner], score, other, 1)


def negatives_of(anchors: Rows, batches: Iterator[Rows]) -> Iterator[bytes]:
    """Keys of the NEGATIVES best rows of other labels in the window of each of an anchor's positives."""
    low_share, high_share, whole = WINDOW
    counts = np.array([len(w) // 8 for w in anchors.windows])
    p = np.frombuffer(b"".join(anchors.windows), "<i8")
    owner = np.repeat(np.arange(len(counts)), counts)  # of each window its anchor
    owner, p = owner[p >= 0], p[p >= 0]  # below zero no score fits
    low, high = -((-low_share * p) // whole), high_share * p // whole
    first = np.searchsorted(owner, np.arange(len(counts) + 1))
    bounds = np.full((len(counts), 2), (1, 0))  # the hull of an anchor's windows
    if len(owner):
        has = np.flatnonzero(np.diff(first))
        bounds[has, 0], bounds[has, 1] = np.minimum.reduceat(low, first[has]), np.maximum.reduceat(high, first[has])
    found = Pruned(NEGATIVES)
    for rows in batches:
        for k in range(0, len(counts), TILE):
            mine = np.arange(k, min(k + TILE, len(counts)))
            s = scores(anchors.x[mine], rows.x)
            fits = (s >= bounds[mine, :1]) & (s <= bounds[mine, 1:]) & (anchors.labels[mine][:, None] != rows.labels) & (anchors.ids[mine][:, None] != rows.ids)
            i, j = np.nonzero(fits)
            score, other = s[i, j], rows.ids[j]
            order = np.lexsort((other, -score, i))
            i, score, other = i[order], score[order], other[order]
            begins = np.searchsorted(i, np.arange(len(mine) + 1))
            for w in range(POSITIVES):  # of each anchor its w-th window: the first pairs that aren't above it
                at = np.flatnonzero(first[mine] + w < first[mine + 1])
                window = first[mine[at]] + w
                start = begins[at] + _above(score, begins[at], begins[at + 1], high[window])
                for step in range(NEGATIVES):
                    place = start + step
                    inside = place < begins[at + 1]
                    inside[inside] &= score[place[inside]] >= low[window[inside]]
                    found.add(window[inside], score[place[inside]], other[place[inside]])
    window, score, other = found.all()
    at = owner[window]
    unique = np.unique(np.rec.fromarrays([at, score, other])) if len(at) else np.rec.fromarrays([at, score, other])  # a pair may be in several windows
    yield from _blobs(anchors.ids[unique.f0], unique.f1, unique.f2, 0)


def _above(score: np.ndarray, begin: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the falling scores from begin to end are above most, segment by segment; by halving."""
    low, high = begin.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        above = np.zeros(len(low), bool)
        above[open_] = score[middle[open_]] > most[open_]
        low, high = np.where(open_ & above, middle + 1, low), np.where(open_ & ~above, middle, high)
    return low - begin


def _blobs(anchor: np.ndarray, score: np.ndarray, other: np.ndarray, same: int) -> Iterator[bytes]:
    for k in range(0, len(anchor), 50_000):
        yield keys(anchor[k : k + 50_000], score[k : k + 50_000], other[k : k + 50_000], same)


def first_of_each(sorted_keys: Iterable[bytes], k: int) -> Iterator[tuple[int, int, int]]:
    """anchor, id, score of the first k pairs of each anchor."""
    last, count = None, 0
    for key in sorted_keys:
        if key[:8] != last:
            last, count = key[:8], 0
        if count < k:
            count += 1
            anchor, score, other, _ = read_key(key)
            yield anchor, other, score


def mined(sorted_keys: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from each anchor's best score down.

    A positive opens its window; negatives follow it in the order, but where both scores are zero: so the first few
    negatives of score zero are kept for a positive that comes after them.
    """
    low, high, whole = WINDOW
    last, windows, zeros = None, [], []
    for key in sorted_keys:
        anchor, score, other, same = read_key(key)
        if anchor != last:
            last, windows, zeros = anchor, [], []
        if same:
            windows.append([other, score, 0])
            for early in zeros if score == 0 else ():
                windows[-1][2] += 1
                yield anchor, other, windows[-1][2], early, 0, 0
            continue
        if score == 0 and len(zeros) < NEGATIVES:
            zeros.append(other)
        for window in windows:
            if window[2] < NEGATIVES and low * window[1] <= whole * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], other, window[1], score


def _streams(batches: Iterator[pa.RecordBatch], width: int, work: Callable) -> Iterator[pa.RecordBatch]:
    """Runs work(anchors, batches of rows) for each (group, slot) of batches that are sorted by group, slot and kind."""

    def runs() -> Iterator[tuple[tuple, int, Rows]]:
        for b in batches:
            if b.num_rows == 0:
                continue
            group, slot, kind = (b.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(slot) != 0) | (np.diff(kind) != 0)])
            for a, z in zip(cuts, np.r_[cuts[1:], b.num_rows], strict=True):
                part = b.slice(a, z - a)
                yield (group[a], slot[a]), int(kind[a]), Rows(part.column(3).to_numpy(), part.column(4).to_numpy(), unpacked(part.column(5), width), part.column(6).to_pylist() if kind[a] == 0 else [])

    stream = runs()
    waiting = next(stream, None)
    while waiting is not None:
        place, parts = waiting[0], []
        while waiting is not None and waiting[0] == place and waiting[1] == 0:
            parts.append(waiting[2])
            waiting = next(stream, None)

        def rows(place=place) -> Iterator[Rows]:
            nonlocal waiting
            while waiting is not None and waiting[0] == place:
                yield waiting[2]
                waiting = next(stream, None)

        if parts:
            anchors = Rows(*(np.concatenate([p[k] for p in parts]) for k in range(3)), [w for p in parts for w in p.windows])
            for blob in work(anchors, rows()):
                yield pa.RecordBatch.from_pydict({"keys": pa.array([blob], pa.binary())})
        for _ in rows():  # a slot without anchors, or what work left
            pass


def _met(anchors: DataFrame, rows: DataFrame, groups: int, slots: int, width: int, work: Callable) -> RDD:
    """Blobs of keys that work finds where each group of anchors meets each slot of rows. Each anchor is sent to each slot
    and each row to each group; both are as large as the parameters say, whatever the tables' sizes."""
    own = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(own.alias("group"), every(slots).alias("slot"), F.lit(0).alias("kind"), "vec_id", "label", "x", "windows")
    place = F.pmod(F.xxhash64("vec_id", "x"), F.lit(slots)).cast("int")
    right = rows.select(every(groups).alias("group"), place.alias("slot"), F.lit(1).alias("kind"), "vec_id", "label", "x", F.lit(None).cast("binary").alias("windows"))
    parts = max(groups * slots, 1)
    dealt = left.unionByName(right).repartitionByRange(parts, "group", "slot").sortWithinPartitions("group", "slot", "kind")
    found = dealt.mapInArrow(functools.partial(_streams, width=width, work=work), "keys binary")
    return found.rdd.map(lambda r: bytes(r[0]))


def mine(rows: DataFrame, anchors: DataFrame, width: int, group: int = GROUP, slot: int = SLOT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors against rows.

    Both have vec_id, label (long) and x, packed whole numbers of width entries. anchors hold an id once. The stages read
    rows twice, so they should be cheap to make again.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, a = rows.count(), anchors.count()
    groups = max(1, math.ceil(a / group))
    slots = max(math.ceil(n / slot), min(math.ceil(n / SMALL_SLOT), math.ceil(2 * spark.sparkContext.defaultParallelism / groups)), 1)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blank = anchors.withColumn("windows", F.lit(b""))
    top = sorted_by_score(_met(blank, rows, groups, slots, width, positives_of), partitions)
    firsts = top.mapPartitions(lambda given: first_of_each(given, POSITIVES))
    # read twice: for the windows, and as keys of the last shuffle
    positives = cut_lineage(spark.createDataFrame(firsts, "vec_id long, positive_id long, score long", verifySchema=False))

    def as_keys(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            if b.num_rows:
                anchor, other, score = (b.column(c).to_numpy() for c in range(3))
                yield pa.RecordBatch.from_pydict({"keys": pa.array([keys(anchor, score, other, 1)], pa.binary())})

    lists = positives.groupBy("vec_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("found"))  # POSITIVES at most

    def with_windows(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            windows = [np.array(w, "<i8").tobytes() for w in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(windows, pa.binary())], ["vec_id", "label", "x", "windows"])

    framed = anchors.join(lists, "vec_id").select("vec_id", "label", "x", "found").mapInArrow(with_windows, "vec_id long, label long, x binary, windows binary")
    pairs = _met(framed, rows, groups, slots, width, negatives_of).union(positives.mapInArrow(as_keys, "keys binary").rdd.map(lambda r: bytes(r[0])))
    return spark.createDataFrame(sorted_by_score(pairs, partitions).mapPartitions(mined), schema, verifySchema=False)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The negatives of all anchors, ids divisible by 50, of one table.

    Rows take no part with a null id, label or vector, a null or non-finite entry, another number of entries than most, or
    an entry c with |256 c| of 2^28 or more, whose products wouldn't fit. Rows that repeat an id are rows of their own,
    but never partners of an anchor of that id; of several rows with an anchor's id the one with the least label, then
    vector, is the anchor. Equal scores go by id. Other columns are dropped, whatever their names. An anchor without a
    positive, and a positive whose window is empty, give no row; so does an empty table.
    """
    width = common_width(df, vector_col)
    label = F.col(label_col).cast("long")
    named = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col(vector_col).alias("vector")
    )
    rows = packed_rows(named, "vector", width, SCALE, ("vec_id", "label"))
    asked = packed_rows(named.where(F.col("vec_id") % 50 == 0), "vector", width, SCALE, ("vec_id", "label"))
    anchors = asked.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*")
    return mine(rows, anchors, width)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
