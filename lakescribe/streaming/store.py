"""A table of chunks by document that a stream replaces exactly once.

Chunks lie in buckets by a hash of document_id. A batch writes new versions of the buckets that it touches, each whole, in a
folder that nobody reads, and then one small commit: from then on the newest version of a bucket is the bucket. A batch
that is run again finds its commit and does nothing, or finds none and writes the same folder anew; a job that dies
between the two leaves the table as it was. Nothing is deleted but by clean().

Folders of versions and commits have names that Spark's readers pass over, so that the table's own folder can hold a plain
copy of the newest buckets for whoever reads without this module (publish): it is right once a batch has ended, and is made
right again by the next or the same batch if one died before that.

Of a document's events the one with the greatest order counts, whichever comes first: each document keeps the order of its
last event, also one that is deleted or has no text, so that a late event doesn't bring it back. One query writes at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, source string, batch_id long, bucket int, buckets int"
#: What each row has beside the chunk's own columns: chunk_index is null in the row that a document without chunks keeps.
KEPT = ("document_id", "event_order", "deleted")
#: Rows of a bucket that one task writes, about, and characters of a text that make a row, for those that aren't cut yet.
SHARE, ROW = 10_000, 2_000


def _dealt(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """About n rows dealt to tasks by bucket; of large buckets each is shared out by document, and has a file of each share."""
    shares = max(1, -(-n // (buckets * SHARE)))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets * shares)
    return rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("document_id", F.lit("share")), F.lit(shares)))


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """None where nothing has been written yet; any other error is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commits(spark: SparkSession, path: str) -> DataFrame:
    """version, source, batch_id, bucket: a row for each bucket that a batch has replaced."""
    found = _read(spark, COMMIT, f"{path}/_log/commits")
    return spark.createDataFrame([], COMMIT) if found is None else found


def _current(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame | None:
    """All rows of the newest versions of buckets, tombstones with them; None where none has been written."""
    newest = commits(spark, path).where("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version"))
    newest = newest if buckets is None else newest.where(F.col("bucket").isin(buckets))
    places = [f"{path}/_data/version={r['version']}/bucket={r['bucket']}" for r in newest.collect()]  # buckets at most
    return spark.read.schema(schema).parquet(*places) if places else None


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's chunks as the last commit left them; schema: their own columns."""
    rows = _current(spark, path, _whole(schema))
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.where("chunk_index is not null").drop("event_order", "deleted")


def _whole(schema: str) -> str:
    return f"{schema}, event_order long, deleted boolean"


def latest(events: DataFrame) -> DataFrame:
    """Of each document the event with the greatest event_order; of equal ones a deletion, then the greatest text."""
    rest = [c for c in events.columns if c != "document_id"]
    first = ["event_order", "deleted", *[c for c in rest if c not in ("event_order", "deleted")]]
    return events.groupBy("document_id").agg(F.max(F.struct(*first)).alias("e")).select("document_id", *[F.col(f"e.{c}").alias(c) for c in rest])


def replace(spark: SparkSession, path: str, events: DataFrame, chunked, schema: str, source: str, batch_id: int, buckets: int, published: bool = False) -> bool:
    """Puts a batch of events in the table; false if this batch of this source is in it already. published: also in the plain copy.

    events: document_id, event_order (long), deleted (boolean), text and what chunked needs; chunked(events) gives the
    chunks of their texts, with schema's columns. Events with null ids are left out; a null order is the least.
    """
    again = [r["bucket"] for r in commits(spark, path).where((F.col("source") == source) & (F.col("batch_id") == batch_id)).collect()]  # buckets at most
    if again:
        if published:
            publish(spark, path, schema, again)
        return False
    version = next_order(spark, path)
    place = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    order = F.coalesce(F.col("event_order").cast("long"), F.lit(-(2**63)))
    new = latest(events.where("document_id is not null").withColumn("event_order", order).withColumn("deleted", F.coalesce("deleted", F.lit(False))))
    touched = sorted(r["bucket"] for r in new.select(place.alias("bucket")).distinct().collect())  # buckets at most
    if touched:
        old = _current(spark, path, _whole(schema), touched)
        if old is not None:  # only what is newer than the table's own
            known = old.groupBy("document_id").agg(F.max("event_order").alias("_known"))
            new = new.join(known, "document_id", "left").where("_known is null or event_order > _known").drop("_known")
        new = new.persist()
        try:
            columns = [c.split()[0] for c in schema.split(", ")]
            live = chunked(new.where("not deleted and text is not null")).select(*columns).join(new.select(*KEPT), "document_id")
            bare = new.select(*KEPT).join(live.select("document_id").distinct(), "document_id", "left_anti")
            rows = live.unionByName(bare, allowMissingColumns=True)
            n = new.agg(F.sum(F.ceil((F.coalesce(F.length("text"), F.lit(0)) + 1) / ROW))).first()[0] or 0
            if old is not None:
                n += old.count()
                rows = old.join(new.select("document_id"), "document_id", "left_anti").unionByName(rows)
            _dealt(rows.withColumn("bucket", place), n, len(touched)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_data/version={version}")
        finally:
            new.unpersist()
    log = spark.createDataFrame([(version, source, batch_id, b, buckets) for b in touched or [-1]], COMMIT)  # a batch of nothing has its commit too
    log.coalesce(1).write.mode("append").parquet(f"{path}/_log/commits")
    if published and touched:
        publish(spark, path, schema, touched)
    return True


def publish(spark: SparkSession, path: str, schema: str, buckets: list[int]) -> None:
    """The plain copy of buckets, at path/bucket=...; a bucket without chunks has no folder."""
    rows = _current(spark, path, _whole(schema), buckets)
    if rows is None:
        return
    place = F.pmod(F.xxhash64("document_id"), F.lit(_buckets(spark, path))).cast("int")
    live = rows.where("chunk_index is not null").drop("event_order", "deleted").withColumn("bucket", place)
    full = {r["bucket"] for r in live.select("bucket").distinct().collect()}  # buckets at most
    _dealt(live, live.count(), len(buckets)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for b in set(buckets) - full - {-1}:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(conf).delete(folder, True)


def _buckets(spark: SparkSession, path: str) -> int:
    """How many buckets the table has, as its first commit says."""
    return commits(spark, path).agg(F.max("buckets")).first()[0]


def next_order(spark: SparkSession, path: str) -> int:
    """An order for events that have none: that of the next version."""
    return (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions of buckets that keep newer ones have taken the place of; returns how many. Readers older than that lose their files."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("version")))
    gone = commits(spark, path).where("bucket >= 0").select("version", "bucket").distinct().withColumn("_r", rank).where(F.col("_r") > keep).collect()  # files' names
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for r in gone:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/_data/version={r['version']}/bucket={r['bucket']}")
        n += bool(place.getFileSystem(conf).delete(place, True))
    return n
