"""Stored objects against the tables: classes of disagreement, a manifest of two witnesses, what may be cleaned up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import UUID, candidate_id, validate_object_path
from .usage import micros

ACTIVE_STAGES = ("validating", "uploading", "extracting", "ocr_fallback", "chunking", "embedding", "indexing")
GRACE_DAYS, MOST_DELETED, STALE_MINUTES = 7, 5, 15
CLASSES = ("STORAGE_ORPHAN", "MISSING_OBJECT", "CHUNK_ORPHAN", "COLLECTION_ORPHAN", "STALE_PROCESSING", "FAILED_WITH_OBJECT", "READY_WITHOUT_COMPLETE_CHUNKS", "DUPLICATE_REFERENCE", "UNEXPECTED_OBJECT")


def is_active() -> Column:
    return (F.col("status") == "processing") | F.coalesce(F.col("processing_stage").isin(*ACTIVE_STAGES), F.lit(False))


def complete_days(first: Column, second: Column) -> Column:
    """Whole days from first to second; -1 if either is missing or they are the wrong way round."""
    days = F.floor((micros(second) - micros(first)) / 86_400_000_000)
    return F.when(second >= first, days).otherwise(-1).cast("int")


def incomplete_ready(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ready documents whose chunks aren't 0 to n - 1, or of which one has no embedding. chunks: document_id, chunk_index, has_embedding."""
    ready, sums = documents.where("status = 'ready'"), _chunk_sums(chunks).where("chunks_whole").select("document_id")
    return ready.join(sums, "document_id", "left_anti").select(*documents.columns)


def _chunk_sums(chunks: DataFrame) -> DataFrame:
    """document_id, chunks_n, chunks_whole: whether a document's chunks are just 0 to n - 1 and all have an embedding."""
    sums = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.count_distinct("chunk_index").alias("different"), F.bool_and("has_embedding").alias("all_embedded"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n")) & F.col("all_embedded")
    return sums.select("document_id", F.col("n").alias("chunks_n"), F.coalesce(whole, F.lit(False)).alias("chunks_whole"))


def duplicate_references(documents: DataFrame) -> DataFrame:
    """storage_path, n, bytes of paths that several documents refer to."""
    return documents.groupBy("storage_path").agg(F.count("*").alias("n"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes")).where("n > 1")


def classify(objects: DataFrame, documents: DataFrame, collections: DataFrame, chunks: DataFrame, now: Column, identifier: str = UUID) -> DataFrame:
    """class, count, bytes for each of CLASSES, zeros included. One aggregate over the paths, one over the documents.

    objects: path, size; documents: document_id, collection_id, storage_path, file_size, status, processing_stage,
    processing_started_at, created_at; collections: collection_id; chunks: document_id, chunk_index, has_embedding.
    """
    size, started = F.coalesce("file_size", F.lit(0)), F.coalesce("processing_started_at", "created_at")
    # what each document is beside its own columns: a row of flags for it
    stored = objects.groupBy(F.col("path").alias("storage_path")).agg(F.count("*").alias("stored_n"), F.sum("size").alias("stored_size"))
    sums = _chunk_sums(chunks)
    docs = documents.select("document_id", "collection_id", "storage_path", "file_size", size.alias("bytes"), (F.col("status") == "failed").alias("failed"), (F.col("status") == "ready").alias("ready"), F.coalesce(is_active() & (started < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")), F.lit(False)).alias("stale"))
    known = collections.select("collection_id").distinct().withColumn("known", F.lit(True))
    by_path = docs.groupBy("storage_path").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("failed").alias("n_failed"), F.sum(F.when(F.col("failed"), F.col("file_size"))).alias("failed_bytes"), F.count_if(F.col("failed") & F.col("file_size").isNull()).alias("failed_unsized")
    )
    paths = by_path.join(stored, "storage_path", "full_outer")
    n, m, zero = F.coalesce("n", F.lit(0)), F.coalesce("stored_n", F.lit(0)), lambda c: F.coalesce(c, F.lit(0))
    own = docs.join(known, "collection_id", "left").join(sums, "document_id", "full_outer")
    here = F.col("bytes").isNotNull()
    whole = F.coalesce(F.col("chunks_whole"), F.lit(False))

    def counted(name: str, of: Column, value: Column, times: Column | None = None) -> list[Column]:
        return [F.sum(F.when(of, times if times is not None else F.lit(1)).otherwise(0)).alias(f"{name}_n"), F.sum(F.when(of, value).otherwise(0)).alias(f"{name}_b")]

    of_paths = paths.agg(
        *counted("STORAGE_ORPHAN", (n == 0) & (m > 0), zero(F.col("stored_size")), m),
        *counted("MISSING_OBJECT", (m == 0) & (n > 0), zero(F.col("bytes")), n),
        *counted("DUPLICATE_REFERENCE", n > 1, zero(F.col("bytes")), n),
        *counted("FAILED_WITH_OBJECT", (m > 0) & (zero(F.col("n_failed")) > 0), zero(F.col("failed_bytes")) * m + zero(F.col("failed_unsized")) * zero(F.col("stored_size")), zero(F.col("n_failed")) * m),
        *counted("UNEXPECTED_OBJECT", (m > 0) & validate_object_path(F.col("storage_path"), identifier).isNotNull(), zero(F.col("stored_size")), m),
    )
    of_documents = own.agg(
        *counted("COLLECTION_ORPHAN", here & F.col("known").isNull(), F.col("bytes")),
        *counted("STALE_PROCESSING", here & F.col("stale"), F.col("bytes")),
        *counted("READY_WITHOUT_COMPLETE_CHUNKS", here & F.col("ready") & ~whole, F.col("bytes")),
        *counted("CHUNK_ORPHAN", ~here, F.lit(0), F.col("chunks_n")),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(f"{c}_n", F.lit(0)).cast("long").alias("count"), F.coalesce(f"{c}_b", F.lit(0)).cast("long").alias("bytes")) for c in CLASSES])
    return of_paths.crossJoin(of_documents).select(F.inline(rows))  # one row each


WITNESS = ("object_exists", "reference_count", "processing_count", "size", "created_at", "updated_at", "owner_id", "orphan_confirmed")


def build_manifest(objects: DataFrame, documents: DataFrame, at: Column, previous: DataFrame | None = None, project: str = "project", bucket: str = "documents") -> DataFrame:
    """candidate_id, path, path_sha256, first_witness, second_witness: all paths that are orphans now or were candidates before.

    objects: path, size, created_at, updated_at, owner_id; previous: an earlier manifest. The first witness is the earlier
    one if there is one; then the second is what is seen now.
    """
    references = documents.groupBy(F.col("storage_path").alias("path")).agg(F.count("*").alias("_references"), F.count_if(is_active()).alias("_processing"))
    seen = objects.join(references, "path", "left")
    n, busy = F.coalesce("_references", F.lit(0)), F.coalesce("_processing", F.lit(0))
    here = F.struct(
        at.alias("observed_at"), F.lit(True).alias("object_exists"), n.alias("reference_count"), busy.alias("processing_count"), F.col("size").cast("long").alias("size"),
        F.col("created_at").alias("created_at"), F.col("updated_at").alias("updated_at"), F.col("owner_id").alias("owner_id"), ((n == 0) & (busy == 0)).alias("orphan_confirmed"),
    )
    now = seen.select("path", here.alias("_now"), (n == 0).alias("_orphan"))
    kind = now.schema["_now"].dataType
    gone = F.struct(*[(at if f.name == "observed_at" else F.lit(False) if f.name in ("object_exists", "orphan_confirmed") else F.lit(0) if f.name.endswith("_count") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
    if previous is None:
        both = now.where("_orphan").withColumn("_before", F.lit(None).cast(kind))
    else:
        before = previous.select("path", F.col("first_witness").alias("_before"))
        both = now.join(before, "path", "full_outer").where(F.col("_before").isNotNull() | F.col("_orphan"))
    current = F.coalesce("_now", gone)
    return both.select(
        candidate_id(F.col("path"), project, bucket).alias("candidate_id"),
        "path",
        F.sha2("path", 256).alias("path_sha256"),
        F.coalesce("_before", current).alias("first_witness"),
        F.when(F.col("_before").isNotNull(), current).alias("second_witness"),
    )


def _known(w: str) -> Column:
    c = lambda x: F.col(f"{w}.{x}")
    return F.coalesce((c("size") >= 0) & c("created_at").isNotNull() & c("updated_at").isNotNull() & (F.length(c("owner_id")) > 0), F.lit(False))


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in ("size", "created_at", "updated_at", "owner_id")])


def reasons(now: Column, grace_days: int = GRACE_DAYS, identifier: str = UUID) -> Column:
    """Why a candidate of a manifest may not go, in order; empty if it may."""
    bad_path = validate_object_path(F.col("path"), identifier)
    second = F.col("second_witness").isNotNull()
    ok = lambda w: F.coalesce(F.col(f"{w}.object_exists") & F.col(f"{w}.orphan_confirmed"), F.lit(False))
    return F.array_distinct(F.array_compact(F.array(
        F.coalesce(bad_path, F.when(~F.coalesce(F.col("first_witness.owner_id") == F.element_at(F.split("path", "/"), 1), F.lit(False)), "STORAGE_OWNER_PATH_MISMATCH")),
        F.when(~ok("first_witness"), "FIRST_WITNESS_INVALID"),
        F.when(~_known("first_witness"), "OBJECT_METADATA_UNKNOWN"),
        F.when(~second, "SECOND_WITNESS_MISSING"),
        F.when(second & ~ok("second_witness"), "SECOND_WITNESS_INVALID"),
        F.when(second & (complete_days(F.col("first_witness.observed_at"), F.col("second_witness.observed_at")) < grace_days), "SECOND_WITNESS_TOO_SOON"),
        F.when(second & ~_same("first_witness", "second_witness"), "OBJECT_METADATA_CHANGED"),
        F.when(complete_days(F.col("first_witness.created_at"), now) < grace_days, "AGE_UNDER_GRACE_PERIOD"),
    )))


def eligibility(manifest: DataFrame, now: Column, grace_days: int = GRACE_DAYS, identifier: str = UUID) -> DataFrame:
    """manifest with reasons and state (eligible, ineligible)."""
    out = manifest.withColumn("reasons", reasons(now, grace_days, identifier))
    return out.withColumn("state", F.when(F.size("reasons") == 0, "eligible").otherwise("ineligible"))


def plan(manifest: DataFrame, objects: DataFrame, documents: DataFrame, now: Column, most: int = MOST_DELETED, grace_days: int = GRACE_DAYS, identifier: str = UUID) -> DataFrame:
    """What a cleanup would do, nothing is deleted: manifest's candidates seen again, with reasons, state and refusal.

    refusal is MAX_DELETE_EXCEEDED on all rows if more than most would go.
    """
    live = objects.select("path", F.struct(F.col("size").cast("long").alias("size"), "created_at", "updated_at", "owner_id").alias("_live"))
    references = documents.groupBy(F.col("storage_path").alias("path")).agg(F.count("*").alias("_references"), F.count_if(is_active()).alias("_processing"))
    seen = eligibility(manifest, now, grace_days, identifier).join(live, "path", "left").join(references, "path", "left")
    more = F.array_compact(F.array(
        F.when(F.col("_live").isNull(), "OBJECT_ABSENT").when(~_known("_live"), "LIVE_OBJECT_METADATA_UNKNOWN").when(~_same("first_witness", "_live"), "LIVE_OBJECT_METADATA_CHANGED"),
        F.when(F.coalesce("_references", F.lit(0)) != 0, "CURRENT_DATABASE_REFERENCE"),
        F.when(F.coalesce("_processing", F.lit(0)) != 0, "CURRENT_PROCESSING_REFERENCE"),
    ))
    out = seen.withColumn("reasons", F.array_distinct(F.concat("reasons", more))).withColumn("state", F.when(F.size("reasons") == 0, "eligible").otherwise("ineligible")).drop("_live", "_references", "_processing")
    n = out.agg(F.count_if(F.col("state") == "eligible").alias("n_eligible"))
    return out.join(F.broadcast(n)).withColumn("refusal", F.when(F.col("n_eligible") > most, "MAX_DELETE_EXCEEDED"))
