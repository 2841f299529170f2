"""Keyword scores of candidate chunks: whole question, terms and their forms, prefixes."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.query import expand_roles, search_terms, term_variants
from ..functions.text import normalize, tokens
from . import topk
from .lexical import filename_terms, wanted_terms


def _occurrences(text: Column, word: Column) -> Column:
    """Without overlap."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def _term_score(text: Column, words: Column, term: Column) -> Column:
    """The most hits of the term's forms, 3 each for a long term; without one, words that begin with a form or that a form begins with."""
    hits = F.array_max(F.transform(term_variants(term), lambda v: _occurrences(text, v)))
    long_words = F.filter(words, lambda w: F.length(w) >= 4)
    near = F.array_max(
        F.transform(
            term_variants(term),
            lambda v: F.when(F.length(v) >= 4, F.size(F.filter(long_words, lambda w: w.startswith(v) | v.startswith(w)))).otherwise(0),
        )
    )
    return F.coalesce(F.when(hits > 0, hits * F.when(F.length(term) >= 6, 3).otherwise(1)).otherwise(near), F.lit(0))


def score(candidates: DataFrame, content: str = "content", question: str = "question", terms: str | None = None) -> DataFrame:
    """candidates with keyword_score. terms: a column of the terms to look for; otherwise the question's.

    The normalised texts are columns of a projection of their own, so each is computed once a row.
    """
    text, words, said, asked = fresh(candidates, "text", "words", "said", "asked")
    out = candidates.select(
        "*",
        normalize(F.col(content)).alias(text),
        tokens(F.col(content)).alias(words),
        normalize(expand_roles(F.col(question))).alias(said),
        (F.col(terms) if terms else search_terms(F.col(question))).alias(asked),
    )
    whole = F.when((F.length(said) > 8) & F.contains(F.col(text), F.col(said)), 20).otherwise(0)
    each = F.aggregate(F.transform(asked, lambda t: _term_score(F.col(text), F.col(words), t)), F.lit(0), lambda x, y: x + y)
    every = (F.size(asked) > 1) & F.forall(asked, lambda t: F.exists(term_variants(t), lambda v: F.contains(F.col(text), v)))
    return out.withColumn("keyword_score", whole + each + F.when(every, 8).otherwise(0)).drop(text, words, said, asked)


def candidates(questions: DataFrame, chunks: DataFrame, scope: list[str], keys: list[str], content: str = "content") -> DataFrame:
    """query_id, question, chunks' columns: chunks in scope that can score for a question.

    A form of a term that occurs in a text, or a word that begins with one or that one begins with, has the form's first
    three letters in some word. So a join on these three letters finds each pair that scores above 0, and no others
    are scored.
    """
    thirds = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))
    forms = F.flatten(F.transform(search_terms(F.col("question")), lambda t: F.transform(term_variants(t), lambda v: F.substring(v, 1, 3))))
    wanted = questions.select("query_id", *scope, F.explode(F.array_distinct(forms)).alias("term"))
    some = wanted_terms(wanted)  # letters that no question asks for never become rows
    parts = F.array_distinct(F.flatten(F.transform(F.array_distinct(tokens(F.col(content))), thirds)))
    had = chunks.select(*scope, *keys, F.explode(parts if some is None else F.filter(parts, lambda x: x.isin(some))).alias("term"))
    pairs = wanted.join(had, [*scope, "term"]).select("query_id", *scope, *keys).distinct()
    return pairs.join(chunks, [*scope, *keys]).join(questions, ["query_id", *scope])


#: Questions of a scope that a chunk is read for at once.
BLOCK = 64


def _forms(term: str) -> list[str]:
    """As functions.query.term_variants."""
    n = len(term)
    cut = [term, term[:-3] + "y" if n > 4 and term.endswith("ies") else "", term[:-3] if n > 4 and term.endswith("ing") else "", term[:-2] if n > 4 and term.endswith("ed") else "", term[:-1] if n > 3 and term.endswith("s") else ""]
    return [v for v in dict.fromkeys(cut) if len(v) > 2]


class _Asked:
    """A block of questions: their normalised texts, terms and long terms; all terms with their forms; one automaton of all forms."""

    def __init__(self, block: str):
        import ahocorasick

        self.questions = [(x["said"], x["terms"], [t for t in x["terms"] if len(t) > 2]) for x in json.loads(block)]
        self.terms = {t: _forms(t) for _, terms, _ in self.questions for t in terms}
        self.starts = {v[:k] for own in self.terms.values() for v in own for k in range(4, len(v))}
        self.forms = ahocorasick.Automaton()
        for v in {v for own in self.terms.values() for v in own}:
            self.forms.add_word(v, v)
        self.forms.make_automaton()

    def counted(self, text: str) -> dict[str, int]:
        """The forms that stand in a text and how often, without overlap."""
        return {v: text.count(v) for v in {v for _, v in self.forms.iter(text)}} if len(self.forms) else {}


_asked = lru_cache(maxsize=32)(_Asked)


def _scores(text: str, block: str, without: frozenset[str] = frozenset()) -> list[tuple[int, int, int, int, int]]:
    """Place in the block, keyword_score, n_common, n_words, n_asked of each question that a normalised text can answer.

    As score(), but a text is read once, whichever questions ask for a term. Words that begin with a form hold it; so without
    a hit only words that a form begins with are left, and these are the form's own beginnings.
    """
    asked, words = _asked(block), Counter(text.split())
    count, begun = asked.counted(text), asked.starts & words.keys()
    worth = {}
    for t, own in asked.terms.items():
        n = max([count.get(v, 0) for v in own], default=0)
        near = max([sum([words[v[:k]] for k in range(4, len(v)) if v[:k] in begun]) for v in own], default=0) if begun and not n else 0
        worth[t] = n, n * (3 if len(t) >= 6 else 1) or near
    out = []
    for place, (said, every, long) in enumerate(asked.questions):
        terms = [t for t in every if t not in without] if without else every
        found = sum(worth[t][1] for t in terms)
        whole = 20 if len(said) > 8 and said in text else 0
        common = sum(t in words for t in long)
        if found + whole + common:
            out.append((place, found + whole + (8 if len(terms) > 1 and all(worth[t][0] for t in terms) else 0), common, len(words), len(long)))
    return out


def search(questions: DataFrame, chunks: DataFrame, scope: list[str], keys: list[str], content: str = "content", without: Column | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, scope, keys, keyword_score, term_cosine: each chunk with each question of its scope that it has anything of.

    As score() of candidates(), without their shuffles: a scope's questions are dealt to blocks of about so many, and a chunk
    is read once for each. term_cosine: of the set of a chunk's words and that of the question's terms of three letters or
    more, null where they share none. without: words that don't count as terms of this chunk.
    """
    asked = questions.where(F.col("question").isNotNull()).select(*scope, F.struct("query_id", normalize(expand_roles(F.col("question"))).alias("said"), search_terms(F.col("question")).alias("terms")).alias("_q"))
    shares = asked.groupBy(*scope).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = asked.join(shares, scope).groupBy(*scope, F.pmod(F.xxhash64("_q.query_id"), F.col("_n")).alias("_share")).agg(F.collect_list("_q").alias("_own"))
    blocks = dealt.select(*scope, F.transform("_own", lambda x: x["query_id"]).alias("_ids"), F.to_json(F.transform("_own", lambda x: F.struct(x["said"].alias("said"), x["terms"].alias("terms")))).alias("_block"))

    @F.pandas_udf("array<struct<place:int,score:int,common:int,words:int,asked:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, questions_of, left in batches:
            yield pd.Series([_scores(x, q, frozenset(w.split())) for x, q, w in zip(texts, questions_of, left, strict=True)], dtype=object)

    left = F.lit("") if without is None else F.coalesce(F.array_join(without, " "), F.lit(""))
    texts = chunks.where(F.col(content).isNotNull()).select(*scope, *keys, normalize(F.col(content)).alias("_text"), left.alias("_left"))
    met = texts.join(blocks, scope).select(*scope, *keys, "_ids", F.explode(run("_text", "_block", "_left")).alias("_x"))
    cosine = F.round(F.col("_x.common") / F.sqrt(F.col("_x.words") * F.col("_x.asked")), 6)
    return met.select(F.get("_ids", F.col("_x.place")).alias("query_id"), *scope, *keys, F.col("_x.score").alias("keyword_score"), F.when(F.col("_x.common") > 0, cosine).alias("term_cosine"))


def rank(scored: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Of each question the best by score, file name and place."""
    return topk.per_group(scored.where("keyword_score > 0"), by or ["query_id"], [F.desc("keyword_score"), F.col("filename"), F.col("chunk_index"), F.col("chunk_id")], limit, "keyword_rank")


def per_document_limit(limit: int, documents: Column | int) -> Column:
    """How many candidates of each of so many documents: three times the limit shared out, 3 to 10."""
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return F.least(F.greatest(F.ceil(F.lit(limit * 3) / n), F.lit(3)), F.lit(10)).cast("int")


def rank_scoped(questions: DataFrame, chunks: DataFrame, scope: list[str], keys: list[str], limit: int, documents: int) -> DataFrame:
    """The best of each document of each question, scored without the terms of the document's file name."""
    scored = search(questions, chunks, scope, keys, without=filename_terms(F.col("filename")))
    best = min(max(-(-limit * 3 // documents), 3), 10)
    return rank(scored, best, ["query_id", "document_id"])
