"""The folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir. Where it is unset a session whose executors are its own threads gets a temporary folder; any other a ValueError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read from there: computed once, and there whatever becomes of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
