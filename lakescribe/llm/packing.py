"""Best-fit packing of tokenised documents into sequences of at most CAPACITY tokens, planned on the histogram of lengths.

How many pieces there are of each length is all that best-fit decreasing needs, and that is at most CAPACITY numbers at
any size of input. The plan says which run of ranks within a length goes to which run of sequences at which offset; its
size is bounded by CAPACITY alone. Each piece then takes the slot planned for its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .wordpieces import word_pieces

CAPACITY, END = 2048, 0
#: A length's pieces are dealt out over groups of about 1 / GROUPS of what a task has on average, or of LEAST.
GROUPS, LEAST = 8, 64


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32: each text's ids and the end id, cut at multiples of capacity only if there are more."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        store, last = word_pieces(path), end.to_bytes(4, "little")

        def pieces(text: str | None) -> list[tuple]:
            ids = store.packed(text or "") + last
            return [(k, k * capacity, (len(x := ids[k * capacity * 4 : (k + 1) * capacity * 4])) // 4, zlib.crc32(x)) for k in range(-(-len(ids) // (4 * capacity)))]

        for texts in batches:
            yield pd.Series([pieces(x) for x in texts], dtype=object)

    cuts = cut(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cuts).alias("x")).select("doc_id", "x.*")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): best-fit decreasing over counts; ranks and sequences from 0.

    Sequences with equal room form runs. Pieces of one length are placed a run at a time, in the run with the least room
    that suffices; what a piece leaves over goes back as a run of the new room.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, how many)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        room = length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:  # all in new sequences, as many to each as it holds, and the rest in one more
                each = capacity // length
                full, over = divmod(left, each)
                for k in range(each if full else 0):
                    slots.append((length, rank, full, opened, k * length))
                    rank += full
                if full:
                    free[capacity - each * length].append((opened, full))
                    opened += full
                for k in range(over):
                    slots.append((length, rank, 1, opened, k * length))
                    rank += 1
                if over:
                    free[capacity - over * length].append((opened, 1))
                    opened += 1
                break
            first, many = free[room].pop()
            taken = min(many, left)
            slots.append((length, rank, taken, first, capacity - room))
            if many > taken:
                free[room].append((first + taken, many - taken))
            if room > length:
                free[room - length].append((first, taken))
                room = max(length, room - length) if room - length >= length else room
            rank += taken
            left -= taken
        # free[0] is never looked at again
        free[0].clear()
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    pieces is written to the checkpoint folder once, as it is read three times. Ranks: a length with many pieces is dealt
    out by where its rows stand there, so that rows that are equal throughout part too and no task ranks much more than
    any other; the groups' counts, at most GROUPS a task and one a length, are summed up to give each group its first
    rank. The plan is broadcast: it depends on capacity, not on the input.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces.withColumn("place", F.monotonically_increasing_id()))  # written, so it stays as it is
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots = plan(counts, capacity)
    together = max(LEAST, sum(counts.values()) // (GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(k, -(-n // together)) for k, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts"))).drop("salts")
    firsts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("place")
    ranked = salted.withColumn("in_salt", F.row_number().over(order) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("in_salt"))
    places = spark.createDataFrame(slots, "slot_length long, rank_from long, many long, sequence_from long, offset long")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("many"))
    return ranked.join(F.broadcast(places), fits).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    Null text counts as empty and gives one piece, the end id alone. Rows with equal ids, or null ones, are packed as
    rows of their own. Other columns are dropped, whatever their names. An empty table gives an empty one.
    """
    return pack(token_pieces(docs, path, id_col, text_col, capacity, end), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
