"""The pipeline's stages against plain versions of them."""

import os

import pytest

import corpus_pipeline
from lakescribe.llm import language_id, pu_quality, simhash

from .test_simhash import brute_classes

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@given
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    before, after = kept["language_id"]
    judged = language_id.predict(before, language_id.fit(language_id.learnable(before)))
    assert ids(after) == ids(judged.where("not rejected"))
    assert after.count() > 0.97 * before.count()

    before, after = kept["quality_classifier"]
    judged = pu_quality.predict(before, pu_quality.fit(*pu_quality.learnable(before, labels)))
    assert ids(after) == ids(judged.where("predicted = 1"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & set(ids(after))) > 0.97 * len(good & set(ids(before)))

    before, after = kept["near_dedup"]
    rows = sorted(before.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    classes = brute_classes([simhash.fingerprint(r["text"]) for r in rows])
    assert ids(after) == sorted(rows[k]["doc_id"] for k in set(classes))

    before, after = kept["best_fit_packing"]
    packed = after.toPandas()
    assert sorted(packed["doc_id"].unique()) == ids(before)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(zip(packed["doc_id"], packed["piece"], packed["ids_crc32"], strict=True))


@pytest.fixture
def own_tables(spark, tmp_path):
    """A folder whose labels say little."""
    spark.createDataFrame([(5, 1, 0), (6, 1, None), (8, None, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_odd_rows(spark, odd_docs, own_tables):
    rows = {str(r["doc_id"]): r["text"] for r in odd_docs.collect()}
    kept = corpus_pipeline.keep_known_language(spark, odd_docs, own_tables)
    assert kept.columns == COLUMNS
    ids = [str(r["doc_id"]) for r in kept.collect()]
    assert set(ids) <= {k for k, t in rows.items() if t and any(c.isalpha() for c in t)} and ids.count("5") == 2  # the repeated row is there twice
    good = corpus_pipeline.keep_good_quality(spark, odd_docs, own_tables)
    assert good.columns == COLUMNS and {"5", "6"} <= {str(r["doc_id"]) for r in good.collect()}
    once = corpus_pipeline.keep_one_of_near_duplicates(spark, odd_docs, own_tables)
    classes = brute_classes([simhash.fingerprint(r["text"]) for r in odd_docs.collect()])
    assert once.columns == COLUMNS and once.count() == len(set(classes))
    packed = corpus_pipeline.pack_sequences(spark, odd_docs, own_tables)
    assert packed.where("piece = 0").count() == odd_docs.count() and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_nothing_to_learn_from(spark, odd_docs, no_docs, own_tables, tmp_path):
    """Without a model rows stay; an empty table passes through."""
    unlabelled = odd_docs.drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert corpus_pipeline.keep_known_language(spark, unlabelled, own_tables).count() == odd_docs.count()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "other" / "labels.parquet"))
    assert corpus_pipeline.keep_good_quality(spark, odd_docs, str(tmp_path / "other")).count() == odd_docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, own_tables).count() == 0
    no_docs.select(*COLUMNS).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.read.parquet(f"{own_tables}/labels.parquet").write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
