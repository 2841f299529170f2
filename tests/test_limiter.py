"""The fixed-window limiter: a walk by windows is one by events, also for a user with a million of them."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lakescribe.streaming import limits


def test_windows_are_those_of_a_walk_by_events():
    rnd = random.Random(3)
    for _ in range(300):
        at = np.sort([rnd.randrange(200) for _ in range(rnd.randrange(40))]).astype(np.int64)
        end, used, length = rnd.randrange(100), rnd.randrange(4), rnd.choice([1, 7, 50])
        places, e, u = [], end, used
        for x in at:
            if x >= e:
                e, u = x + length, 0
            u += 1
            places.append(u)
        got = limits.windows_used(at, end, used, length)
        assert got[0].tolist() == places and got[1:] == (e, u)


def test_a_user_with_a_million_events(spark, tmp_path):
    own = spark.range(0, 1_000_000, 1, 4).select(F.col("id").alias("event_id"), F.when(F.col("id") % 100 == 0, 2).otherwise(1).cast("long").alias("user_id"), F.timestamp_micros(F.col("id") * 50_000 + 10**15).alias("ts"))
    own.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in")
    began = time.time()
    limits.fixed_window_limiter(stream, 5, 60).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert time.time() - began < 90
    out = spark.read.parquet(f"{tmp_path}/out")
    rows = out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("ok")).orderBy("user_id").collect()
    want = []
    for user, ids in ((1, (k for k in range(1_000_000) if k % 100)), (2, range(0, 1_000_000, 100))):
        end = n = used = ok = 0
        for k in ids:
            if k * 50_000 >= end:
                end, used = k * 50_000 + 60_000_000, 0
            used, n = used + 1, n + 1
            ok += used <= 5
        want.append((user, n, ok))
    assert [tuple(r) for r in rows] == want
