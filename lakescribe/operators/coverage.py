"""From a ranking to what is shown: no repeats, documents in balance, required documents present."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import normalize

MEANINGFUL, QUALIFYING, SIMILAR, SOFT_CAP, KEY_CHARACTERS = 24, 40, 0.55, 2, 600


def is_meaningful(content: Column, least: int = MEANINGFUL) -> Column:
    return F.length(normalize(content)) >= least


def is_qualifying(content: Column, keyword_score: Column, similarity: Column, least: int = QUALIFYING) -> Column:
    """Enough text, and a keyword score above 0 or a similarity of 0.55."""
    return is_meaningful(content, least) & ((F.coalesce(keyword_score, F.lit(0.0)) > 0) | (F.coalesce(similarity, F.lit(-1.0)) >= SIMILAR))


def with_keys(ranked: DataFrame, least: int = MEANINGFUL) -> DataFrame:
    """ranked (document_id, chunk_index, content; maybe file_kind, location_label, page_number) with location_key and content_key."""
    has = lambda c: F.col(c).cast("string") if c in ranked.columns else F.lit(None).cast("string")
    label = F.coalesce(F.nullif(F.trim(has("location_label")), F.lit("")), F.concat_ws(":", F.coalesce(has("page_number"), F.lit("null")), has("chunk_index")))
    text = normalize(F.col("content"))
    return ranked.withColumn("location_key", F.concat_ws(":", has("document_id"), F.coalesce(has("file_kind"), F.lit("unknown")), label, has("chunk_index"))).withColumn(
        "content_key", F.when(F.length(text) >= least, F.concat_ws(":", has("document_id"), F.substring(text, 1, KEY_CHARACTERS)))
    )


def first_wins(rows: Iterable[tuple]) -> list[bool]:
    """Whether each row stays: none of its keys is that of a row that stayed before; a row that goes leaves no keys."""
    seen: set[tuple[int, object]] = set()
    out = []
    for row in rows:
        keys = {(k, x) for k, x in enumerate(row) if x is not None}
        out.append(not keys & seen)
        if out[-1]:
            seen |= keys
    return out


def dedupe(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, rank, chunk_id and the keys' columns) without repeats, the better rank stays.

    Whether a row stays depends on all before it, so each question's candidates, which fusion has bounded, are walked in
    order; only ids and keys go through Python.
    """
    keyed = with_keys(ranked)
    few = keyed.select("query_id", "rank", "chunk_id", F.xxhash64("location_key").alias("l"), F.when(F.col("content_key").isNotNull(), F.xxhash64("content_key")).alias("c"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        contents = [None if pd.isna(x) else x for x in frame["c"].astype(object)]
        return frame.loc[first_wins(zip(frame["chunk_id"], frame["l"], contents, strict=True)), ["query_id", "rank"]]

    schema = f"query_id {dict(ranked.dtypes)['query_id']}, rank {dict(ranked.dtypes)['rank']}"
    return ranked.join(few.withColumn("c", F.col("c").cast("string")).groupBy("query_id").applyInPandas(walk, schema), ["query_id", "rank"])


def balance(ranked: DataFrame, limit: int, cap: int = SOFT_CAP) -> DataFrame:
    """At most cap of each document first, then the others as they were ranked, limit in all; with final_rank."""
    of_document = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))
    (late,) = fresh(ranked, "late")
    marked = ranked.withColumn(late, (of_document > cap).cast("int"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(late, "rank"))
    return marked.withColumn("final_rank", final).where(F.col("final_rank") <= limit).drop(late)


def select(ranked: DataFrame, required: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows chosen (query_id, chunk_id, final_rank) and required documents that are missing (query_id, document_id).

    ranked: qualifying rows without repeats; required: query_id, document_id. With two or more required documents, all of
    them among the rows and no more than limit, the last row whose document is chosen twice or not required gives way
    to the best row of each required document that isn't chosen.
    """
    few = ranked.select("query_id", "rank", "chunk_id", "document_id").join(
        required.groupBy("query_id").agg(F.sort_array(F.collect_set("document_id")).alias("required")), "query_id", "left"
    )
    kinds = dict(ranked.dtypes)

    def swap(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("rank")[["chunk_id", "document_id"]].itertuples(index=False, name=None))
        wanted = frame["required"].iat[0]
        wanted = [] if wanted is None else list(wanted)
        chosen, had = rows[:limit], {d for _, d in rows}
        if 2 <= len(wanted) <= limit and all(d in had for d in wanted):
            for d in wanted:
                if any(x[1] == d for x in chosen):
                    continue
                counts = pd.Series([x[1] for x in chosen]).value_counts()
                k = next((k for k in reversed(range(len(chosen))) if counts[chosen[k][1]] > 1 or chosen[k][1] not in wanted), None)
                if k is not None:
                    chosen[k] = next(x for x in rows if x[1] == d)
        return pd.DataFrame({"query_id": frame["query_id"].iat[0], "chunk_id": [x[0] for x in chosen], "document_id": [x[1] for x in chosen], "final_rank": range(1, len(chosen) + 1)})

    chosen = few.groupBy("query_id").applyInPandas(swap, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, final_rank int")
    several = required.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where("_n > 1").drop("_n")
    return chosen, several.join(chosen, ["query_id", "document_id"], "left_anti")
