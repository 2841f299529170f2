"""The table of chunks that a stream replaces exactly once."""

import pytest

from lakescribe.streaming import limits, store

SCHEMA = "document_id long, chunk_index int, content string"


@pytest.fixture
def put(spark, tmp_path):
    path = f"{tmp_path}/chunks"

    def run(rows, batch, source="s"):
        events = spark.createDataFrame([(*r, False)[:4] if len(r) == 3 else r for r in rows], "document_id long, event_order long, text string, deleted boolean")
        return store.replace(spark, path, events, limits.chunk_stream, SCHEMA, source, batch, 3)

    run.path = path
    run.now = lambda: sorted((r["document_id"], r["chunk_index"], r["content"]) for r in store.read(spark, path, SCHEMA).collect())
    return run


def test_twice_in_a_batch(put):
    assert put.now() == []
    put([(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (2, 1, "two"), (None, 1, "nobody's")], 0)
    assert put.now() == [(1, 0, "new"), (2, 0, "two")]


def test_emptied_deleted_and_late(put):
    put([(1, 5, "a"), (2, 5, "b"), (3, 5, "c"), (4, None, "d")], 0)
    put([(1, 6, ""), (2, 6, None, True), (3, 4, "late")], 1)
    assert put.now() == [(3, 0, "c"), (4, 0, "d")]
    put([(1, 5, "late for an empty one"), (2, 5, "late for a deleted one"), (4, 1, "e")], 2)
    assert put.now() == [(3, 0, "c"), (4, 0, "e")]
    put([(2, 7, "back")], 3)
    assert put.now() == [(2, 0, "back"), (3, 0, "c"), (4, 0, "e")]


def test_replayed_batch(spark, put):
    assert put([(1, 1, "a")], 0) and put([(1, 2, "b")], 1)
    before = store.commits(spark, put.path).count()
    assert not put([(1, 9, "never")], 1) and not put([(1, 9, "never")], 0)
    assert put.now() == [(1, 0, "b")] and store.commits(spark, put.path).count() == before
    assert put([], 2) and not put([(1, 9, "never")], 2)  # a batch of nothing is one too
    assert put([(1, 9, "c")], 1, "another query") and put.now() == [(1, 0, "c")]


def test_killed_batch(spark, put, monkeypatch):
    """A job that dies after its files and before its commit leaves the table; the batch that is run again is whole."""
    put([(k, 1, f"first {k}") for k in range(20)], 0)
    before = put.now()

    real = spark.createDataFrame

    def dies(data, schema=None, **more):
        if schema == store.COMMIT and data:
            raise KeyboardInterrupt
        return real(data, schema, **more)

    events = spark.createDataFrame([(k, 2, f"second {k}", False) for k in range(0, 20, 2)], "document_id long, event_order long, text string, deleted boolean")
    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(KeyboardInterrupt):
        store.replace(spark, put.path, events, limits.chunk_stream, SCHEMA, "s", 1, 3)
    monkeypatch.undo()
    assert put.now() == before
    put([(k, 2, f"second {k}") for k in range(0, 20, 2)], 1)
    assert put.now() == sorted((k, 0, f"{'first' if k % 2 else 'second'} {k}") for k in range(20))


def test_other_errors_are_errors(spark, put, tmp_path):
    """Only a table that isn't there counts as empty."""
    (tmp_path / "chunks" / "_log").mkdir(parents=True)
    (tmp_path / "chunks" / "_log" / "commits").write_text("no folder of Parquet")
    with pytest.raises(Exception, match="commits"):
        put([(1, 1, "a")], 0)


def test_clean(spark, put):
    for k in range(4):
        put([(1, k, f"v{k}"), (2, k, f"w{k}")], k)
    assert store.clean(spark, put.path, 1) > 0 and put.now() == [(1, 0, "v3"), (2, 0, "w3")]
    assert store.clean(spark, put.path, 1) == 0


def test_large_buckets_are_shared_out(spark, tmp_path, monkeypatch):
    """A bucket of many rows is written by several tasks, in the table and in its plain copy, also where it is old rows that are many."""
    monkeypatch.setattr(store, "SHARE", 10)
    path = f"{tmp_path}/chunks"

    def put(rows, batch):
        events = spark.createDataFrame([(k, batch, text, False) for k, text in rows], "document_id long, event_order long, text string, deleted boolean")
        store.replace(spark, path, events, limits.chunk_stream, SCHEMA, "s", batch, 2, published=True)

    put([(k, f"first {k}") for k in range(100)], 0)
    put([(k, f"second {k}") for k in range(0, 100, 10)], 1)
    want = sorted((k, f"{'first' if k % 10 else 'second'} {k}") for k in range(100))
    assert sorted((r[0], r[2]) for r in store.read(spark, path, SCHEMA).collect()) == want
    assert sorted((r[0], r[2]) for r in spark.read.schema(SCHEMA).parquet(path).collect()) == want
    for folder in ("_data/version=1/bucket=0", "_data/version=2/bucket=0", "bucket=0"):
        assert len(list((tmp_path / "chunks" / folder).glob("*.parquet"))) > 1, folder


def test_a_stream_started_anew(spark, tmp_path):
    """A running query that is stopped and started again goes on where it was."""
    schema = "document_id long, event_order long, text string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        limits.ingest(docs, f"{tmp_path}/t", f"{tmp_path}/c", None, 3, available_now=True).awaitTermination()
        spark.createDataFrame([(2, 3, ""), (3, 1, "c")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    limits.ingest(docs, f"{tmp_path}/t", f"{tmp_path}/c", None, 3, available_now=True).awaitTermination()
    assert sorted((r[0], r[2]) for r in store.read(spark, f"{tmp_path}/t", SCHEMA).collect()) == [(1, "a"), (3, "c")]
    assert sorted((r[0], r[2]) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (3, "c")]  # the plain copy
