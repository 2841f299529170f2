"""Whole jobs: documents to searchable chunks, questions to ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import chunking, coverage, extraction, fusion, lexical, pii, sanitize, scope, semantic, topk


#: What a chunk keeps of its unit.
PROVENANCE = ("block_type", "heading_path", "location_label", "source_location", "line_start", "line_end", "row_start", "row_end", "code_language", "table_context", "title")


def process(docs: DataFrame, most_chunks: int = chunking.MOST, extractors: dict | None = None) -> DataFrame:
    """A row for each document with what became of it: document_id, user_id, collection_id, filename, processing_mode, kind,
    status, failed_stage, error, n_units, char_count, word_count, n_chunks, units, chunks.

    docs: those of the first five, and content (binary) or text, and mime_type where it is known. Stages in order, of which
    the first that a document doesn't pass is its failed_stage: validating (name, size, first bytes, characters, too little
    in a text file), extracting (markup that isn't safe, a file its extractor can't read, too little or too much in it),
    chunking (no chunk, or more than most_chunks). units are cleaned; chunks: unit_index, chunk_part, content and PROVENANCE.
    A table's rows stay together. A document is worked on where it is read: no shuffle, and a bad file fails its row alone.
    """
    own = ["document_id", "user_id", "collection_id", "filename", "processing_mode"]
    content = F.col("content") if "content" in docs.columns else F.col("text").cast("binary")
    mime = F.col("mime_type") if "mime_type" in docs.columns else F.lit(None).cast("string")
    read = extraction.validated(docs.select(*own, content.alias("content"), mime.alias("mime_type")), extractors)
    found = extraction.extracted(read, extractors, wanted=F.col("invalid").isNull())
    cleaned = F.transform("units", lambda u: u.withField("text", sanitize.clean(u["text"])))
    known = extraction.judged(found.withColumn("units", cleaned).drop("content"), extractors)

    def parts(unit: Column, k: Column) -> Column:
        texts = F.when(unit["block_type"] == "table_row", F.array(F.trim(unit["text"]))).otherwise(chunking.windows(unit["text"]))
        return F.transform(texts, lambda x, p: F.struct(k.alias("unit_index"), p.alias("chunk_part"), x.alias("content"), *[unit[f].alias(f) for f in PROVENANCE]))

    chunks = F.filter(F.flatten(F.transform("units", parts)), lambda c: c["content"] != "")
    cut = known.withColumn("chunks", F.when(F.col("error").isNull(), chunks)).withColumn("n_chunks", F.coalesce(F.size("chunks"), F.lit(0)).cast("long"))
    late = F.when(F.col("error").isNull(), F.when(F.col("n_chunks") > most_chunks, "too_many_chunks").when(F.col("n_chunks") == 0, "no_chunks"))
    cut = cut.withColumn("failed_stage", F.when(late.isNotNull(), "chunking").otherwise(F.col("failed_stage"))).withColumn("error", F.coalesce("error", late))
    return cut.select(*own, "kind", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), "failed_stage", "error", "n_units", "char_count", "word_count", "n_chunks", "units", "chunks")


def chunks_of(processed: DataFrame, secret: str) -> DataFrame:
    """The chunks of process()'s ready documents, a row each, with their unit's provenance; the private ones masked."""
    own = ["document_id", "user_id", "collection_id", "filename", "processing_mode", F.col("kind").alias("file_kind")]
    # no filter on what was computed: Spark would put the whole computation in the filter's place, and again behind it
    rows = processed.select(*own, F.posexplode_outer(F.when(F.col("status") == "ready", F.col("chunks"))).alias("chunk_index", "c")).where("chunk_index is not null")
    return pii.projected(rows.select(*own[:-1], "file_kind", "chunk_index", "c.*"), secret)


def ingest(docs: DataFrame, secret: str, most_chunks: int = chunking.MOST, extractors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, statuses) of documents of every kind, as process() and chunks_of() say. Both come from one plan; whoever
    writes both should write process()'s rows once and take them from there."""
    processed = process(docs, most_chunks, extractors)
    return chunks_of(processed, secret), processed.select("document_id", "status", "failed_stage", "error", "n_chunks")


FUSIONS = {"rrf": fusion.rrf, "weighted": fusion.weighted}
#: Candidates that each required document may have at least, and chunks of a question that nothing is found for.
PER_REQUIRED, BROAD = 3, 3


#: Chunks that a batch's questions may be sent to every task for their texts; more meet their texts by a shuffle.
SENT = 500_000


def lexical_lane(questions: DataFrame, chunks: DataFrame, documents: DataFrame, secret: str, most: int) -> DataFrame:
    """query_id, chunk_id, keyword_score: the best most chunks of each question by words, each in its own user's collection.

    Chunks of private documents are found by their masked texts, without file names; a question that holds personal data
    is masked for each of them, any other asks them as it stands. A chunk's text is read where it lies: only its sums for
    the questions meet the documents; texts of private documents are moved where questions are masked for these.
    """
    scope, keys = ["collection_id", "user_id"], ["chunk_id", "document_id", "chunk_index"]
    own = documents.where("status = 'ready'").select("document_id", "collection_id", "user_id", "filename", (F.col("processing_mode") == "privacy_minimised").alias("_private"))
    tells = F.coalesce(F.col("question").rlike(pii.HINT), F.lit(False))
    pairs = questions.where(tells).join(own.where("_private").select(*scope, "document_id"), scope)
    of_document = pairs.withColumn("question", pii.mask(F.col("question"), pii.scope_id(F.col("user_id"), F.col("document_id")), secret))
    told = kept(lexical.question_clauses(of_document, [*scope, "document_id"]))
    asked, quiet = lexical.question_clauses(questions, scope), lexical.question_clauses(questions.where(~tells), scope)
    texts = chunks.select(*keys, "collection_id", "content", "provider_safe_content")
    # a collection's questions of all users are held against its chunks; whose a chunk is, is known by its document
    users = questions.select("query_id", F.col("user_id").alias("_asks"))
    here = lambda clauses, column: lexical.scan(clauses.drop("user_id"), texts.where(F.col(column).isNotNull()), ["collection_id"], [*keys, "collection_id"], {"content": column})
    plain = here(asked, "content").withColumn("_masked", F.lit(False)).unionByName(here(quiet, "provider_safe_content").withColumn("_masked", F.lit(True)))
    mine = plain.join(users, "query_id").join(own.drop("filename"), ["document_id", "collection_id"]).where((F.col("_masked") == F.col("_private")) & (F.col("_asks") == F.col("user_id")))
    found = mine.select("query_id", *keys, "r", "named")
    named = lexical.scan(asked, own.where("not _private"), scope, ["document_id", "collection_id"], {"filename": "filename"})
    named = chunks.select(*keys, "collection_id").join(named, ["document_id", "collection_id"]).select("query_id", *keys, "r", "named")
    found = found.unionByName(named).groupBy("query_id", *keys).agg(F.sum("r").alias("r"), F.max("named").alias("named"))
    if not told.isEmpty():
        hidden = texts.join(own.where("_private").drop("filename"), ["document_id", "collection_id"])
        found = found.unionByName(lexical.scan(told, hidden, [*scope, "document_id"], keys, {"content": "provider_safe_content"}))
    found = lexical.ranked(found)
    if "document_ids" in questions.columns:
        found = found.join(questions.select("query_id", "document_ids"), "query_id").where(F.coalesce(F.size("document_ids") <= 0, F.lit(True)) | F.array_contains("document_ids", F.col("document_id")))
    scored = found.select("query_id", *keys, F.round("rank", 6).alias("keyword_score"))
    return topk.per_group(scored, ["query_id"], [F.desc("keyword_score"), F.col("document_id"), F.col("chunk_index"), F.col("chunk_id")], most, "_r").select("query_id", "chunk_id", "keyword_score")


def semantic_lane(questions: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, semantic_similarity: the nearest most chunks with a vector, in the same scope: a question that names documents in each of these.

    vectors: chunk_id, document_id, collection_id, user_id, embedding."""
    place = lambda *parts: F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    own = place("collection_id", "user_id")
    v = vectors.select(F.col("chunk_id").alias("vec_id"), "embedding", own.alias("scope"))
    q = questions.select("query_id", "embedding", own.alias("scope"))
    if "document_ids" in questions.columns:
        some = F.coalesce(F.size("document_ids") > 0, F.lit(False))
        named = questions.where(some).select("query_id", "embedding", "collection_id", "user_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
        by_document = ("collection_id", "user_id", "document_id")
        wanted = named.select(*by_document).distinct()
        v = v.unionByName(vectors.join(wanted, [*by_document], "left_semi").select(F.col("chunk_id").alias("vec_id"), "embedding", place(*by_document).alias("scope")))
        q = questions.where(~some).select("query_id", "embedding", own.alias("scope")).unionByName(named.select("query_id", "embedding", place(*by_document).alias("scope")))
    near = semantic.search(q, v, most, "scope")
    return near.select("query_id", F.col("vec_id").alias("chunk_id"), F.round("similarity", 9).alias("semantic_similarity"))


def _texts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of chunks whose ids are wanted: these go to the texts where there are SENT or fewer, else both are shuffled."""
    ids = wanted.select("chunk_id").distinct()
    return chunks.join(F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids, "chunk_id", "left_semi")


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, secret: str, limit: int = 5, lane: int = 20, mode: str = "rrf", vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, document_id, final_rank, retrieval_mode, reason; query_id, document_id of required documents that are missing).

    questions: query_id, user_id, collection_id, question, embedding, and maybe document_ids, the documents that are asked of
    (two or more must all be in the answer, if they can). chunks: chunk_id, document_id, collection_id, chunk_index,
    content, provider_safe_content, and embedding, unless vectors (chunk_id, embedding) is given. documents: document_id,
    collection_id, user_id, filename, status, processing_mode. Of both lanes the best lane chunks are fused by mode, an identifier is rescued, repeats and chunks
    without enough text go, and what is left is balanced over documents, or chosen so that required documents are there.
    Where a lane finds nothing the other stands alone; where both do, a question has the first chunks of its scope.
    """
    columns = ["chunk_id", "document_id", "collection_id", "chunk_index"]
    ready = scope.join_documents(chunks.select(*columns), documents)  # ids alone
    near = ready.join((chunks if vectors is None else vectors).where("embedding is not null").select("chunk_id", "embedding"), "chunk_id")
    merged = kept(fusion.merge(lexical_lane(questions, chunks, documents, secret, lane), semantic_lane(questions, near, lane)))
    several = F.coalesce(F.size("document_ids"), F.lit(0)) if "document_ids" in questions.columns else F.lit(0)
    asked = questions.select("query_id", "collection_id", "user_id", "question", several.alias("_several"), *([F.col("document_ids")] if "document_ids" in questions.columns else []))
    shown = ["content", *[c for c in ("file_kind", "location_label", "page_number") if c in chunks.columns]]
    texts = scope.join_documents(_texts(chunks.select(*columns, *shown), merged), documents).select("chunk_id", "document_id", "chunk_index", "filename", *shown)
    full = merged.join(texts, "chunk_id").join(asked.select("query_id", "question", "_several"), "query_id")
    wide = 3 * limit
    most = F.greatest(F.lit(wide), F.col("_several") * PER_REQUIRED)
    fused = FUSIONS[mode](fusion.with_boost(full), 2 * lane).where((F.col("rank") <= most) | F.col("bears_identifier"))
    ranked = fusion.rescue_identifier(fused, wide) if mode == "rrf" else fused.where(F.col("rank") <= most)
    clean = kept(coverage.dedupe(ranked).where(coverage.is_meaningful(F.col("content"))).select("query_id", "rank", "chunk_id", "document_id", "retrieval_mode", "_several", "keyword_score", "semantic_similarity"))
    balanced = coverage.balance(clean.where("_several < 2"), limit).select("query_id", "chunk_id", "document_id", "final_rank")
    if "document_ids" in questions.columns:
        required = asked.where("_several > 1").select("query_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
        covered, missing = coverage.select(clean.where("_several > 1"), required, limit)
        balanced = balanced.unionByName(covered)
    else:
        missing = clean.select("query_id", "document_id").where("false")
    lanes = clean.groupBy("query_id").agg(F.bool_or(F.col("semantic_similarity").isNotNull()).alias("_s"), F.bool_or(F.col("keyword_score").isNotNull()).alias("_k"))
    reason = F.when(F.col("_s") & F.col("_k"), "hybrid_match").when(F.col("_s"), "semantic_match").otherwise("direct_keyword_match")
    found = balanced.join(clean.select("query_id", "chunk_id", "retrieval_mode"), ["query_id", "chunk_id"]).join(lanes, "query_id")
    found = found.select("query_id", "chunk_id", "document_id", "final_rank", "retrieval_mode", reason.alias("reason"))
    empty = asked.join(clean.select("query_id").distinct(), "query_id", "left_anti").join(ready.select("user_id", *columns), ["collection_id", "user_id"])
    if "document_ids" in questions.columns:
        empty = empty.where((F.col("_several") == 0) | F.array_contains("document_ids", F.col("document_id")))
    broad = topk.per_group(empty, ["query_id"], [F.col("document_id"), F.col("chunk_index"), F.col("chunk_id")], min(BROAD, limit), "final_rank")
    broad = broad.select("query_id", "chunk_id", "document_id", "final_rank", F.lit("keyword").alias("retrieval_mode"), F.lit("broad_context_fallback").alias("reason"))
    return found.unionByName(broad), missing
