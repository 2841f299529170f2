"""Shared by the training-data operators: table reading, checkpoints, splits."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share.

    Where that is unset a session of one machine, as in tests, gets a temporary folder; on a cluster it is a ValueError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % n).cast("int")


def held_out(id_col: str, n: int, left: int) -> Column:
    """True where the remainder is left. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(remainder(id_col, n) == left, F.lit(True))


def at_most(df: DataFrame, most: int) -> DataFrame:
    """df where it has most rows or fewer; else about most of them, by where they stand. No task takes in the others' rows."""
    n = df.count()
    if n <= most:
        return df
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000))
    return df.where(place < int(1_000_000 * most / n))


def bounded_sample(df: DataFrame, bound: int, id_col: str) -> DataFrame:
    """About bound rows of df, chosen by a hash of the id and so the same each time; at most about twice bound.

    Rows of one id are chosen together; where that makes them more than twice bound, about twice bound of them stay.
    """
    count = df.count()
    if count <= bound:
        return df
    share = int(1_000_000 * bound / count)
    return at_most(df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < share), 2 * bound)
