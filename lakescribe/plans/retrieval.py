"""Queries that answer the benchmark's questions from the documents' chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as q
from ..functions import text as t
from ..operators import coverage, fusion, keyword, lexical, lexical_index, matching, semantic, topk
from ..sources.shared import kept
from .common import CHUNKS, QUESTIONS, chunks, documents, norm, questions, table, tokens, useful, workspace

SCOPE, KEYS = ["collection_id"], ["chunk_id", "document_id", "filename", "chunk_index"]


def _lexical(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return lexical.ranked(lexical.scan(lexical.question_clauses(asked, SCOPE), chunks(spark, sf_dir), SCOPE, KEYS, {"content": "content", "filename": "filename"}))


def lexical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that a question of the benchmark matches, with rank_score."""
    return _lexical(spark, sf_dir, questions(spark, sf_dir)).withColumn("rank_score", F.round("rank", 6)).drop("rank")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each question."""
    best = topk.per_group(lexical_ranks(spark, sf_dir), ["query_id"], [F.desc("rank_score"), F.col("document_id"), F.col("chunk_index")], 5)
    return best.select("query_id", "chunk_id", "rank_score", "rank")


_POST = f"""{CHUNKS}, {QUESTIONS},
post AS (SELECT chunk_id, document_id, collection_id, filename, chunk_index, 0 AS named, 0.2::DOUBLE AS w, unnest({tokens("content")}) AS term, unnest(range(len({tokens("content")}))) AS pos FROM chunks
  UNION ALL SELECT chunk_id, document_id, collection_id, filename, chunk_index, 1, 1.0, unnest({tokens("filename")}), unnest(range(len({tokens("filename")}))) FROM chunks)"""
_QT = f"qt AS (SELECT query_id, collection_id, unnest({useful(tokens('question[1:500]'))}) AS term FROM questions)"
#: SQL of lexical_ranks(), as s.
RANKED = f"""{_POST}, {_QT},
r AS (SELECT query_id, chunk_id, document_id, chunk_index, sum(w) AS r, max(named) AS named FROM qt JOIN post USING (collection_id, term) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, document_id, chunk_index, round(r / (r + 1) + 0.25 * named, 6) AS rank_score FROM r)"""
LEXICAL_TOPK = f"""
WITH {RANKED}
SELECT query_id, chunk_id, rank_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, document_id, chunk_index) AS rank FROM s) WHERE rank <= 5
"""


def lexical_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 stored: an index of all chunks, a fifth of the documents with other texts; these come again as they are, the index is
    made one, and two batches of questions are asked of it. The five best chunks of each question, as lexical_topk."""
    path, keys, fields = f"{workspace(spark)}/index", ["chunk_id", "document_id", "chunk_index", *SCOPE], {"filename": "filename", "content": "content"}
    own = chunks(spark, sf_dir)
    stale = F.col("document_id") % 5 == 0
    old = own.withColumn("content", F.when(stale, F.lit("these words were here before")).otherwise(F.col("content")))
    ids = documents(spark, sf_dir).select("document_id")
    lexical_index.add_chunks(old, keys, fields, ids, path, 32)
    lexical_index.add_chunks(own.where(stale), keys, fields, ids.where(stale), path)
    found = None
    for half in (0, 1):
        clauses = lexical.question_clauses(questions(spark, sf_dir).where(F.col("query_id") % 2 == half), SCOPE)
        rows = lexical.search(clauses, lexical_index.read(spark, path, lexical.wanted_terms(clauses)), SCOPE, keys[:3])
        found = rows if found is None else found.unionByName(rows)
        lexical_index.compact(spark, path)
    best = topk.per_group(found.withColumn("rank_score", F.round("rank", 6)).drop("rank"), ["query_id"], [F.desc("rank_score"), F.col("document_id"), F.col("chunk_index")], 5)
    return best.select("query_id", "chunk_id", "rank_score", "rank")


LEXICAL_STORED = LEXICAL_TOPK


def lexical_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question as two quoted phrases, its first three words and the three after."""
    words = t.tokens(F.col("question"))
    quoted = lambda k: F.concat(F.lit('"'), F.array_join(F.slice(words, k, 3), " "), F.lit('"'))
    asked = questions(spark, sf_dir).select("query_id", "collection_id", F.concat_ws(" and ", quoted(1), quoted(4)).alias("question"))
    return _lexical(spark, sf_dir, asked).select("query_id", "chunk_id", F.round("rank", 6).alias("rank_score"))


LEXICAL_PHRASE = f"""
WITH {_POST}, q AS (SELECT query_id, collection_id, {tokens("question")} AS w FROM questions),
c AS (SELECT DISTINCT query_id, collection_id, unnest([w[1:3], w[4:6]]) AS p FROM q),
h AS (SELECT query_id, p, chunk_id, named, pos - k AS start, max(post.w) AS w FROM (SELECT query_id, collection_id, p, unnest(p) AS term, unnest(range(len(p))) AS k FROM c) JOIN post USING (collection_id, term)
  GROUP BY query_id, p, chunk_id, named, start HAVING count(DISTINCT k) = len(p)),
r AS (SELECT query_id, chunk_id, sum(w) AS r, max(named) AS named FROM h GROUP BY ALL)
SELECT query_id, chunk_id, round(r / (r + 1) + 0.25 * named, 6) AS rank_score FROM r
"""


def lexical_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of odd documents are private: found by their content only."""
    fields = {"filename": "filename", "content": "content"}
    all_chunks = chunks(spark, sf_dir)
    asked = questions(spark, sf_dir).withColumn("question", F.concat_ws(" ", F.lit("txt"), "question"))
    clauses = lexical.question_clauses(asked, SCOPE)
    terms = lexical.wanted_terms(clauses)
    plain = lexical.build_postings(all_chunks.where("document_id % 2 = 0"), [*KEYS, *SCOPE], fields, terms)
    masked = lexical.build_postings(all_chunks.where("document_id % 2 = 1"), [*KEYS, *SCOPE], fields, terms)
    found = lexical.search_by_mode(clauses, plain, masked, SCOPE, KEYS)
    return found.select("query_id", "chunk_id", F.round("rank", 6).alias("rank_score"))


LEXICAL_BY_MODE = f"""
WITH {_POST}, qt AS (SELECT query_id, collection_id, unnest({useful(tokens("('txt ' || question)[1:500]"))}) AS term FROM questions),
r AS (SELECT query_id, chunk_id, sum(w) AS r, max(named) AS named FROM qt JOIN post USING (collection_id, term) WHERE NOT (document_id % 2 = 1 AND named = 1) GROUP BY ALL)
SELECT query_id, chunk_id, round(r / (r + 1) + 0.25 * named, 6) AS rank_score FROM r
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.search(questions(spark, sf_dir), chunks(spark, sf_dir), SCOPE, KEYS)


def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best chunks of each question."""
    return keyword.rank(_scored(spark, sf_dir), 20).select("query_id", "chunk_id", "keyword_score", "keyword_rank")


_VARIANTS = """list_filter([term, CASE WHEN length(term) > 4 AND term LIKE '%ies' THEN term[:-4] || 'y' END, CASE WHEN length(term) > 4 AND term LIKE '%ing' THEN term[:-4] END,
  CASE WHEN length(term) > 4 AND term LIKE '%ed' THEN term[:-3] END, CASE WHEN length(term) > 3 AND term LIKE '%s' THEN term[:-2] END], lambda v: v IS NOT NULL AND length(v) > 2)"""


def _keyword_sql(terms: str) -> str:
    return f"""{CHUNKS}, {QUESTIONS},
pair AS (SELECT query_id, chunk_id, document_id, filename, chunk_index, {norm("content")} AS txt, {norm("question")} AS ask, {terms} AS terms FROM questions JOIN chunks USING (collection_id)),
term AS (SELECT query_id, chunk_id, txt, string_split(txt, ' ') AS words, unnest(terms) AS term FROM pair),
v AS (SELECT *, {_VARIANTS} AS vs FROM term),
h AS (SELECT query_id, chunk_id, length(term) AS n, list_max(list_transform(vs, lambda v: (length(txt) - length(replace(txt, v, ''))) // length(v))) AS hits,
  list_max(list_transform(vs, lambda v: CASE WHEN length(v) >= 4 THEN len(list_filter(words, lambda w: length(w) >= 4 AND (starts_with(w, v) OR starts_with(v, w)))) ELSE 0 END)) AS near FROM v),
s AS (SELECT query_id, chunk_id, count(*) AS n_terms, count(*) FILTER (hits > 0) AS n_hit, sum(coalesce(CASE WHEN hits > 0 THEN hits * CASE WHEN n >= 6 THEN 3 ELSE 1 END ELSE near END, 0)) AS s FROM h GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, document_id, filename, chunk_index, ((CASE WHEN length(ask) > 8 AND contains(txt, ask) THEN 20 ELSE 0 END) + s + CASE WHEN n_terms > 1 AND n_hit = n_terms THEN 8 ELSE 0 END)::INTEGER AS keyword_score FROM pair JOIN s USING (query_id, chunk_id))"""


_ALL_TERMS = useful(tokens("question"))
_SCORED = _keyword_sql(_ALL_TERMS)
KEYWORD_RANK = f"""
WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, filename, chunk_index, chunk_id)::INTEGER AS keyword_rank FROM scored WHERE keyword_score > 0)
SELECT query_id, chunk_id, keyword_score, keyword_rank FROM r WHERE keyword_rank <= 20
"""


def keyword_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best chunks of each document, without the terms of its name."""
    asked = questions(spark, sf_dir).withColumn("question", F.concat_ws(" ", "collection_id", "question"))
    return keyword.rank_scoped(asked, chunks(spark, sf_dir), SCOPE, KEYS, 5, 10).select("query_id", "chunk_id", "keyword_score", "keyword_rank")


_ASKED = "(SELECT query_id, collection_id, collection_id || ' ' || question AS question FROM questions)"
KEYWORD_SCOPED = f"""
WITH {_keyword_sql(f"list_filter({useful(tokens('question'))}, lambda t: NOT list_contains({tokens('filename')}, t))").replace("FROM questions JOIN", f"FROM {_ASKED} JOIN")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY keyword_score DESC, filename, chunk_index, chunk_id)::INTEGER AS keyword_rank FROM scored WHERE keyword_score > 0)
SELECT query_id, chunk_id, keyword_score, keyword_rank FROM r WHERE keyword_rank <= 3
"""


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every vector whose id is divisible by 50, among all."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = semantic.search(asked, v.select("vec_id", "embedding"), 20)
    return near.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
SEMANTIC_TOPK = f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
"""


def semantic_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 within a collection: labels stand for collections."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = semantic.search(asked, v, 5, scope="label")
    return near.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


SEMANTIC_SCOPED = f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS s FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""


def semantic_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 neighbours of each question; the best three of each document, twenty in all. A document is ten ids in a row."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = semantic.search(asked, v.select("vec_id", "embedding"), 100).drop("rank").withColumn("document_id", F.floor(F.col("vec_id") / 10))
    return semantic.search_per_document(near, 5, 10).select("query_id", "document_id", "vec_id", "document_rank", "rank")


SEMANTIC_PER_DOCUMENT = f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.vec_id // 10 AS document_id, {_COSINE} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY s DESC, vec_id)::INTEGER AS document_rank FROM n WHERE k <= 100)
SELECT query_id, document_id, vec_id, document_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM d WHERE document_rank <= 3) WHERE rank <= 20
"""


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes' best twenty, merged, with the chunks' columns and boosts. The semantic lane: cosine of the sets of terms."""
    scored = kept(_scored(spark, sf_dir).drop("collection_id"))  # read by both lanes; numbers and names alone
    similar = scored.where("term_cosine > 0").withColumn("semantic_similarity", F.col("term_cosine"))
    lane = topk.per_group(similar, ["query_id"], [F.desc("semantic_similarity"), F.col("filename"), F.col("chunk_index"), F.col("chunk_id")], 20)
    merged = kept(fusion.merge(keyword.rank(scored, 20), lane))
    few = merged.select(F.shiftright("chunk_id", 20).alias("document_id")).distinct()
    own = chunks(spark, sf_dir, few)
    full = merged.join(own, "chunk_id").join(questions(spark, sf_dir).select("query_id", "question"), "query_id")
    return fusion.with_boost(full)


_RERANK_STOPS = ", ".join(f"'{w}'" for w in fusion.STOP_WORDS)
_FUSED = f"""{_SCORED},
kw AS (SELECT query_id, chunk_id, keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, filename, chunk_index, chunk_id) AS k FROM scored WHERE keyword_score > 0) WHERE k <= 20),
sets AS (SELECT p.query_id, p.chunk_id, p.filename, p.chunk_index, list_distinct(list_filter(string_split(txt, ' '), lambda x: x <> '')) AS own, list_filter(terms, lambda x: length(x) > 2) AS asked FROM pair p),
sem AS (SELECT query_id, chunk_id, semantic_similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_similarity DESC, filename, chunk_index, chunk_id) AS k FROM
  (SELECT *, round(len(list_intersect(own, asked)) / sqrt(len(own) * len(asked)), 6) AS semantic_similarity FROM sets) WHERE semantic_similarity > 0) WHERE k <= 20),
m AS (SELECT coalesce(kw.query_id, sem.query_id) AS query_id, coalesce(kw.chunk_id, sem.chunk_id) AS chunk_id, keyword_score::DOUBLE AS keyword_score, semantic_similarity FROM kw FULL JOIN sem ON kw.query_id = sem.query_id AND kw.chunk_id = sem.chunk_id),
b AS (SELECT m.*, p.document_id, p.filename, p.chunk_index, p.txt, least(1.0, (CASE WHEN contains(p.ask, {norm("p.filename")}) THEN 0.7 ELSE 0 END) + CASE WHEN len(list_filter(
  {useful(tokens('p.ask'), _RERANK_STOPS)}, lambda x: length(x) >= 6 AND contains(p.txt, x))) > 0 THEN 0.15 ELSE 0 END)::DOUBLE AS boost FROM m JOIN pair p USING (query_id, chunk_id)),
k AS (SELECT *, CASE WHEN keyword_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC NULLS LAST, filename, chunk_index, chunk_id) END AS keyword_rank,
  CASE WHEN semantic_similarity IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY semantic_similarity DESC NULLS LAST, filename, chunk_index, chunk_id) END AS semantic_rank,
  CASE WHEN keyword_score IS NOT NULL AND semantic_similarity IS NOT NULL THEN 'hybrid' WHEN keyword_score IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS retrieval_mode FROM b),
f AS (SELECT *, coalesce(1.0 / (60 + keyword_rank), 0)::DOUBLE + coalesce(1.0 / (60 + semantic_rank), 0)::DOUBLE + 0.001 * boost AS fusion_score FROM k),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, filename, chunk_index, chunk_id)::INTEGER AS rank FROM f)"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best of both lanes by reciprocal ranks."""
    return fusion.rrf(_lanes(spark, sf_dir), 15).select("query_id", "chunk_id", F.round("fusion_score", 8).alias("fusion_score"), "retrieval_mode", "rank")


RRF_FUSION = f"WITH {_FUSED} SELECT query_id, chunk_id, round(fusion_score, 8) AS fusion_score, retrieval_mode, rank FROM fused WHERE rank <= 15"


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best by weighted scores."""
    return fusion.weighted(_lanes(spark, sf_dir), 5).select("query_id", "chunk_id", F.round("fusion_score", 6).alias("fusion_score"), "rank")


_STRETCH = "CASE WHEN {c} IS NULL THEN 0 WHEN min({c}) OVER w = max({c}) OVER w THEN 1 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
WEIGHTED_FUSION = f"""
WITH {_FUSED}, ws AS (SELECT *, ({_STRETCH.format(c="semantic_similarity")}) * 0.55::DOUBLE + ({_STRETCH.format(c="keyword_score")}) * 0.35::DOUBLE + boost * 0.1::DOUBLE AS ws FROM b WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(ws, 6) AS fusion_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ws, 12) DESC, filename, chunk_index, chunk_id)::INTEGER AS rank FROM ws) WHERE rank <= 5
"""


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fused fifteen, two of each document first."""
    return coverage.balance(fusion.rrf(_lanes(spark, sf_dir), 15), 5).select("query_id", "chunk_id", "rank", "final_rank")


BALANCE = f"""
WITH {_FUSED}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) > 2 AS late FROM fused WHERE rank <= 15)
SELECT query_id, chunk_id, rank, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank)::INTEGER AS final_rank FROM d) WHERE final_rank <= 5
"""


def rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question asks for a code too, which its twelfth chunk alone bears and so takes the fifth place."""
    code = F.concat(F.lit("INC-"), (F.col("query_id") + 5000).cast("string"))
    ranked = fusion.rrf(_lanes(spark, sf_dir), 20).withColumn("question", F.concat_ws(" ", "question", code)).withColumn("content", F.when(F.col("rank") == 12, F.concat_ws(" see ", "content", F.lower(code))).otherwise(F.col("content")))
    return fusion.rescue_identifier(fusion.with_boost(ranked), 5).select("query_id", "chunk_id", "rank")


RESCUE = f"WITH {_FUSED} SELECT query_id, chunk_id, CASE WHEN rank = 12 THEN 5 ELSE rank END::INTEGER AS rank FROM fused WHERE rank <= 4 OR rank = 12 OR (rank = 5 AND query_id NOT IN (SELECT query_id FROM fused WHERE rank = 12))"


def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused fifteen without repeated places and contents."""
    return coverage.dedupe(fusion.rrf(_lanes(spark, sf_dir), 15)).select("query_id", "chunk_id", "rank")


DEDUPE_GREEDY = f"""
WITH {_FUSED}, keyed AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, document_id, CASE WHEN length(txt) >= 24 THEN txt[1:600] ELSE chunk_id::VARCHAR END ORDER BY rank) AS n FROM fused WHERE rank <= 15)
SELECT query_id, chunk_id, rank FROM keyed WHERE n = 1
"""


def coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of the fused fifteen and the last are both required; what is chosen."""
    ranked = fusion.rrf(_lanes(spark, sf_dir), 15)
    required = ranked.groupBy("query_id").agg(F.array(F.min_by("document_id", "rank"), F.max_by("document_id", "rank")).alias("d")).select("query_id", F.explode(F.array_distinct("d")).alias("document_id"))
    return coverage.select(ranked, required, 5)[0].select("query_id", "chunk_id", "document_id", "final_rank")


COVERAGE_SELECT = f"""
WITH {_FUSED}, fifteen AS (SELECT * FROM fused WHERE rank <= 15), final AS (SELECT query_id, max_by(document_id, rank) AS d FROM fifteen GROUP BY query_id),
held AS (SELECT x.query_id, min(x.rank) AS best FROM fifteen x JOIN final y ON y.query_id = x.query_id AND x.document_id = y.d GROUP BY ALL)
SELECT x.query_id, chunk_id, document_id, least(rank, 5)::INTEGER AS final_rank FROM fifteen x JOIN held y ON y.query_id = x.query_id WHERE (best <= 5 AND rank <= 5) OR (best > 5 AND (rank <= 4 OR rank = best))
"""


def document_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a file, matched to the documents of their collection."""
    named = F.concat(F.lit("What does "), "collection_id", F.lit("-"), (F.col("query_id") * 20 + F.col("query_id") % 20).cast("string"), F.when(F.col("query_id") % 2 == 0, F.lit(".txt")).otherwise(F.lit(" text file")), F.lit(" say?"))
    asked = questions(spark, sf_dir).withColumn("question", named)
    return matching.match_documents(asked, documents(spark, sf_dir).drop("text"), SCOPE).select("query_id", "document_id", "score", "match_class", "is_best")


_STOPS = ", ".join(f"'{w}'" for w in matching.STOP_WORDS + matching.KIND_WORDS)
DOCUMENT_MATCH = f"""
WITH {QUESTIONS}, asked AS (SELECT query_id, collection_id, 'What does ' || collection_id || '-' || (query_id * 20 + query_id % 20) || CASE WHEN query_id % 2 = 0 THEN '.txt' ELSE ' text file' END || ' say?' AS question FROM questions),
doc AS (SELECT doc_id AS document_id, source AS collection_id, source || '-' || doc_id || '.txt' AS filename, source || ' ' || doc_id AS base FROM documents),
p AS (SELECT query_id, document_id, filename, {norm("question")} AS said, {norm("filename")} AS name, base, list_filter({tokens("question")}, lambda t: length(t) > 1 AND t NOT IN ({_STOPS})) AS terms, string_split(base || ' txt', ' ') AS parts FROM asked JOIN doc USING (collection_id)),
s AS (SELECT *, contains(said, name) AS ex, contains(said, base) AS ba, len(list_filter(terms, lambda t: len(list_filter(parts, lambda x: t = x OR (length(t) >= 4 AND contains(x, t)) OR (length(x) >= 4 AND contains(t, x)))) > 0)) AS n FROM p),
c AS (SELECT query_id, document_id, filename, ((CASE WHEN ex THEN 120 ELSE 0 END) + (CASE WHEN ba THEN 100 ELSE 0 END) + 18 * n + (CASE WHEN len(terms) > 0 AND n = len(terms) THEN 45 ELSE 0 END) + 35 + CASE WHEN len(terms) = 0 THEN 20 ELSE 0 END)::INTEGER AS score,
  CASE WHEN ex THEN 'exact' WHEN len(terms) > 0 AND (ba OR n = len(terms)) THEN 'strong' WHEN len(terms) = 0 THEN 'kind_only' WHEN n > 0 THEN 'near' ELSE 'none' END AS match_class FROM s)
SELECT query_id, document_id, score, match_class, row_number() OVER (PARTITION BY query_id ORDER BY CASE match_class WHEN 'exact' THEN 5 WHEN 'strong' THEN 4 WHEN 'near' THEN 2 WHEN 'kind_only' THEN 1 END DESC, score DESC, filename, document_id) = 1 AS is_best FROM c WHERE match_class <> 'none'
"""


def inventory_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a collection has."""
    asked = questions(spark, sf_dir).withColumn("question", F.when(F.col("query_id") % 2 == 0, "Which files are available?").otherwise(F.col("question")))
    return matching.inventory_answer(asked, documents(spark, sf_dir).drop("text"), SCOPE)


INVENTORY_ANSWER = f"""
WITH {QUESTIONS}, d AS (SELECT source AS collection_id, source || '-' || doc_id || '.txt' AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
a AS (SELECT collection_id, max(n) AS n, string_agg('- ' || f, chr(10) ORDER BY k) AS t FROM d WHERE k <= 12 GROUP BY collection_id)
SELECT query_id, CASE WHEN n IS NULL THEN 'I do not see any uploaded documents in this workspace yet.' ELSE 'I found ' || n || ' uploaded ' || CASE WHEN n = 1 THEN 'document' ELSE 'documents' END || ' in this workspace:' || chr(10) || chr(10) || t
  || CASE WHEN n > 12 THEN chr(10) || chr(10) || 'There are ' || (n - 12) || ' more documents in this workspace.' ELSE '' END END AS answer FROM questions LEFT JOIN a USING (collection_id) WHERE query_id % 2 = 0
"""

QUERIES = {
    "lexical_topk": (lexical_topk, LEXICAL_TOPK),
    "lexical_stored": (lexical_stored, LEXICAL_STORED),
    "lexical_phrase": (lexical_phrase, LEXICAL_PHRASE),
    "lexical_by_mode": (lexical_by_mode, LEXICAL_BY_MODE),
    "keyword_rank": (keyword_rank, KEYWORD_RANK),
    "keyword_scoped": (keyword_scoped, KEYWORD_SCOPED),
    "semantic_topk": (semantic_topk, SEMANTIC_TOPK),
    "semantic_scoped": (semantic_scoped, SEMANTIC_SCOPED),
    "semantic_per_document": (semantic_per_document, SEMANTIC_PER_DOCUMENT),
    "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "weighted_fusion": (weighted_fusion, WEIGHTED_FUSION),
    "balance": (balance, BALANCE),
    "rescue": (rescue, RESCUE),
    "dedupe_greedy": (dedupe_greedy, DEDUPE_GREEDY),
    "coverage_select": (coverage_select, COVERAGE_SELECT),
    "document_match": (document_match, DOCUMENT_MATCH),
    "inventory_answer": (inventory_answer, INVENTORY_ANSWER),
}
