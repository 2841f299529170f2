"""Quality rules: a table of thresholds compiled into one projection of counts and ratios; built-in functions only."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The bytes that part words.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were with "
    "au aux avec dans de des du elle en est et il la le les ne pas pour qui que sur un une "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el es esta la las los no para por se su una y"
).split()


class Rule(NamedTuple):
    """Holds when low <= 1000 * count / of <= high, where of counts the text's words, lines or characters. None: no bound."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None


#: What a text must hold that the base rules let through.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 250),
    Rule("exclamations", "n_exclamations", "n_words", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 600),
    Rule("unended_lines", "n_ellipsis_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)


def passes(rule: Rule) -> Column:
    count, of = F.col(rule.count) * 1000, F.col(rule.of)
    low = F.lit(True) if rule.low is None else count >= of * rule.low
    return low if rule.high is None else low & (count <= of * rule.high)


def _count(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated(docs: DataFrame) -> DataFrame:
    """words -> n_repeat_words: words in windows of WINDOW words that occur twice or more, each word once.

    A window is known by a 64-bit hash of its words' hashes, doubled from 1 to 2 to 4 to 8 words. Only texts that have
    equal ones sort them; then each repeated window adds the words up to the next, WINDOW at most.
    """
    docs = docs.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        docs = docs.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.size("_h")), lambda a, b: F.xxhash64(a, b)))
    docs = docs.withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(ordered))
    same = F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda a, b: a["h"].eqNullSafe(b["h"]))
    docs = docs.withColumn("_same", same)  # whether the next one is equal; false for the last
    at = F.transform("_s", lambda x, k: F.when(F.get("_same", k) | F.coalesce(F.get("_same", k - 1), F.lit(False)), x["i"]))
    docs = docs.withColumn("_p", F.sort_array(F.array_compact(at)))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return docs.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y)).drop("_h", "_s", "_same", "_p")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every count that the rules use, of each row's whole text. No shuffle."""
    text = F.col("_text")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    trimmed = F.btrim(text, F.lit(BLANKS))
    docs = docs.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    has_word = lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), has_word))
    size = lambda x: F.size(x).cast("long")
    docs = docs.select(
        "doc_id",
        "words",
        size("words").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "!").alias("n_exclamations"),
        size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis_lines"),
        size(F.filter("_lines", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• "))).alias("n_bullet_lines"),
    )
    return _repeated(docs).drop("words")


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with base_failed, kept and failed (the names of the rules that a text breaks), in one projection."""
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    verdict = reduce(lambda a, b: a & b, (passes(r) for r in rules), F.lit(True))
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return measured.select("*", base.alias("base_failed"), (~base & verdict).alias("kept"), failed.alias("failed"))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each row of docs.

    Null and empty texts have no words and so fail the base rules. Null ids stay null, repeated rows are each judged, other
    columns are dropped whatever their names, an empty table gives an empty one. Ratios are compared as whole numbers, so
    a text that meets a threshold exactly passes. Windows are compared by 64-bit hashes.
    """
    return judge(measure(docs, id_col, text_col), rules)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(rule: Rule) -> str:
    bounds = [f"{rule.count} * 1000 >= {rule.of} * {rule.low}"] * (rule.low is not None) + [f"{rule.count} * 1000 <= {rule.of} * {rule.high}"] * (rule.high is not None)
    return " AND ".join(bounds)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT k, count(DISTINCT i + j) AS n FROM again, range(0, 8) AS r(j) GROUP BY k
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• ')))::BIGINT AS n_bullet_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated r USING (k)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(_sql, RULES))} AS kept
FROM b
"""
