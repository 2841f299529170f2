"""SimHash near-duplicates: fingerprints that differ in DISTANCE bits at most, found with tables of distances to pivots.

The Hamming distances of a fingerprint to PIVOTS fixed reference fingerprints are its coordinates. Two fingerprints within
d bits differ by d at most in each coordinate, so a pair is discarded by its largest difference of coordinates and only
survivors are compared bit by bit. Coordinates alone give no key to join on, as each is near 32 for most fingerprints:
which fingerprints meet is decided by equality in two of five blocks of bits (three differing bits leave two blocks equal),
and the pivots work within a bucket, sorted by the first coordinate. A bucket that is too large for one task is split
anew, by equality in the bits that it hasn't used. A bucket gives the edges of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

DISTANCE, BLOCKS, PIVOTS, SEED, SHINGLE = 3, 5, 16, 42, 3
#: Fingerprints of a bucket that one task compares.
BUCKET = 4096


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and \\x20 \\x09-\\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(len(x) + 1 for x in words))
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    return majority(np.asarray(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col).cast("string")).alias("fp"))


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of these bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Of blocks, all but distance are equal in a pair: a mask for each choice of these."""
    own = _blocks(list(range(64)), blocks)
    return [sum(x) for x in itertools.combinations(own, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The same for the bits that mask lacks: one of distance + 1 blocks of them is equal."""
    return [mask | x for x in _blocks([b for b in range(64) if not mask >> b & 1], distance + 1)]


def forest(fps: np.ndarray, coordinates: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints within distance of each other, by a walk over those not yet reached.

    Sorted by the first coordinate, so only a window of it is looked at; then by the largest difference of the others.
    """
    order = np.argsort(coordinates[:, 0], kind="stable")
    fps, coordinates = fps[order], coordinates[order]
    first = coordinates[:, 0].astype(np.int64)
    left, edges = np.ones(len(fps), bool), []
    lows, highs = np.searchsorted(first, first - distance), np.searchsorted(first, first + distance, "right")
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            x = todo.pop()
            near = lows[x] + np.flatnonzero(left[lows[x] : highs[x]])
            if not len(near):
                continue
            near = near[(np.abs(coordinates[near] - coordinates[x]).max(axis=1)) <= distance]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= distance]
            left[near] = False
            edges += [(int(fps[x]), int(fps[y])) for y in near]
            todo += near.tolist()
    return edges


def _edges(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, key): the edges in each bucket. Small buckets are compared all at once, row by next row."""
    references = pivots()

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
        new = np.r_[True, (frame["mask"].to_numpy()[1:] != frame["mask"].to_numpy()[:-1]) | (frame["key"].to_numpy()[1:] != frame["key"].to_numpy()[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(fps)])
        coordinates = np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)
        found: list[tuple[int, int]] = []
        small = np.repeat(np.where(sizes <= 16, sizes, 0), sizes)  # the rows' own bucket's size
        group = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, min(16, len(fps))):
            a = np.flatnonzero(small[:-step] > step)
            a = a[group[a] == group[a + step]]
            if not len(a):
                break
            a = a[np.abs(coordinates[a] - coordinates[a + step]).max(axis=1) <= distance]
            a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= distance]
            found += zip(fps[a].tolist(), fps[a + step].tolist(), strict=True)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n > 16:
                found += forest(fps[s : s + n], coordinates[s : s + n], distance)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    held: pd.DataFrame | None = None  # the last bucket may go on in the next batch
    for frame in batches:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame["mask"] == frame["mask"].iat[-1]) & (frame["key"] == frame["key"].iat[-1])
        held = frame[last]
        if not last.all():
            yield bucket(frame[~last])
    if held is not None:
        yield bucket(held)


def _keyed(fps: DataFrame, masks: Column) -> DataFrame:
    return fps.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, most: int = BUCKET) -> DataFrame:
    """a, b: edges that connect just the distinct fingerprints fp that are within distance of each other.

    A bucket over most is split by finer masks until it fits, or until its mask lacks so few bits (r) that it can't hold
    more than most (2^r): with the usual most, after four splits. Which masks have such buckets is all the driver hears of.
    """
    whole = 64 - (most.bit_length() - 1)
    rows, out = _keyed(fps, F.array(*[F.lit(_signed(x)) for x in first_masks(distance, blocks)])), None
    while True:
        counts = rows.groupBy("mask", "key").count().where("count > 1")
        rows = cut_lineage(rows.join(counts, ["mask", "key"]))  # most keys have one row and go here
        fits = (F.col("count") <= most) | (F.bit_count("mask") >= whole)
        sorted_rows = rows.where(fits).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        edges = sorted_rows.mapInPandas(lambda x: _edges(x, distance), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        masks = [r["mask"] for r in rows.where(~fits).select("mask").distinct().collect()]
        if not masks:
            return out.distinct()
        finer = [(m, [_signed(y) for y in finer_masks(m & ((1 << 64) - 1), distance)]) for m in masks]
        known = fps.sparkSession.createDataFrame(finer, "mask long, finer array<long>")
        rows = _keyed(rows.where(~fits).join(F.broadcast(known), "mask"), F.col("finer")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a, b) the least node that it is connected with.

    Each round gives each node its least neighbour or itself, follows that to the end (each step doubles the way), and
    contracts: only edges between different ends are left. What is left of the nodes are those that are less than all of
    their neighbours; that can be most of them, as the leaves of a star whose hub is its largest node, which the next round
    brings together around the least of them. Rounds end when no edge is left.
    """
    edges = cut_lineage(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        up = edges.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "node")
        up = edges.select(F.col("a").alias("node")).distinct().join(up, "node", "full_outer").select("node", F.coalesce("up", "node").alias("up"))
        up = cut_lineage(up)
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            further = cut_lineage(up.join(over, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")))
            up = further.select("node", "up")
            if further.where("moved").isEmpty():
                break
        roots = up.withColumnRenamed("up", "root") if roots is None else cut_lineage(
            roots.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        one = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("b", "x")
        edges = one.join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x != y")
        edges = cut_lineage(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of its class) of each row.

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other. Rows with equal ids
    stay rows of their own. Null ids count for no component_id; a class of null ids only has null. Other columns are
    dropped. An empty table gives an empty one. Only distinct fingerprints are compared; the documents of a frequent one
    join its class in a join that Spark may split.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance))
    rooted = cut_lineage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each class of near-duplicates: the one with the least id; all of its columns.

    Of rows that repeat that id one stays, whichever comes first; they are the only rows whose texts are shuffled.
    Rows with a null id stay only where their class has no other, and then one of them.
    """
    found = classes(docs, id_col, text_col, distance)
    own, same = (f"{x}_{'_'.join(docs.columns)}" for x in ("chosen", "same"))  # names that docs can't have
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(same))
    chosen = cut_lineage(chosen)
    kept = docs.join(chosen, F.col(id_col).eqNullSafe(F.col(own)))
    once, often = kept.where(F.col(same) == 1), kept.where(F.col(same) > 1)
    return once.unionByName(often.dropDuplicates([id_col])).select(*docs.columns)
