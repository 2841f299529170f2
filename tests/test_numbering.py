"""Numbers and headings by ranges are those of a window, and no task holds a large group."""

import random

from pyspark.sql import functions as F

from lakescribe.operators import numbering, quality, units


def test_row_numbers(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", None, "b", "c"]), rnd.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, k int")
    whole = sorted(map(tuple, numbering.row_numbers(df, ["g"], ["o", "k"], "r", "n").collect()), key=repr)
    for most in (1, 600, 1000):
        assert sorted(map(tuple, numbering.row_numbers(df, ["g"], ["o", "k"], "r", "n", most).collect()), key=repr) == whole
    down = numbering.row_numbers(df.where("g is null or g = 'b'"), ["g"], [F.desc("o"), F.desc("k")], "r", None, 100).where("r = 1").collect()
    assert all((x["o"], x["k"]) == max((o, k) for g, o, k in rows if g == x["g"]) for x in down) and len(down) == 2
    assert numbering.row_numbers(df.where("false"), ["g"], ["o"], "r", "n", 1).count() == 0


def test_no_task_holds_a_large_table(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.lit("t").alias("t"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), "id")
    out = numbering.row_numbers(df, ["t"], ["o"], "r", "n", 50_000)
    assert out.agg(F.count_distinct("r"), F.min("r"), F.max("r"), F.max("n")).first()[:] == (200_000, 1, 200_000, 200_000)
    of_ranges = out.groupBy(F.spark_partition_id()).count().where("count > 0").collect()
    assert len(of_ranges) > 2 and max(r["count"] for r in of_ranges) < 120_000


def test_table_units_by_ranges(spark):
    rows = [(t, k, f"v{k}" if k % 3 else None) for t, n in (("a", 500), ("b", 30)) for k in range(n)]
    df = spark.createDataFrame(rows, "t string, k int, v string")
    whole = sorted(map(tuple, units.table_units(df, ["t"], ["k"], ["k", "v"]).collect()))
    assert sorted(map(tuple, units.table_units(df, ["t"], ["k"], ["k", "v"], in_task=100).collect())) == whole and len(whole) == 63 + 4


def test_heading_path_by_ranges(spark):
    rnd = random.Random(5)
    rows = [(d, k, rnd.choice([None, None, None, 1, 2, 3, 6]), f"t{d}.{k}") for d in ("x", "y", None) for k in rnd.sample(range(9000), 700)]
    df = spark.createDataFrame(rows, "d string, k int, level int, text string")
    get = lambda most: sorted(((r["d"], r["k"], tuple(r["heading_path"])) for r in units.heading_path(df, ["d"], "k", in_task=most).collect()), key=repr)
    want = []
    for d in ("x", "y", None):
        open_ = []
        for _, k, level, text in sorted(r for r in rows if r[0] == d and d is not None) if d else sorted([r for r in rows if r[0] is None], key=lambda r: r[1]):
            if level:
                open_ = [h for h in open_ if h[0] < level] + [(level, text)]
            want.append((d, k, tuple(t for _, t in open_)))
    assert get(10**6) == get(50) == sorted(want, key=repr)


def test_places_of_documents(spark):
    df = spark.createDataFrame([(k, f"c{k % 2}", ("ready", "awaiting_upload")[k % 3 == 0], k % 7) for k in range(400)], "document_id long, collection_id string, status string, created_at int")
    rows = lambda most: sorted(map(tuple, quality.user_status(df, "processing", most).collect()))
    assert rows(10**6) == rows(20) and len(rows(20)) == 134
