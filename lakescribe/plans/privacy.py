"""Queries over personal data. Values are put into texts by arithmetic, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pii
from .common import spread, table
from .evidence import SECRET

#: A pseudonym without its two tags.
BARE = r"_[0-9A-F]{10}_[0-9A-F]{10}\]"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text about each customer, in one of nine scopes."""
    key = F.col("c_custkey").cast("string")
    number = F.lpad((F.col("c_custkey") % 250).cast("string"), 3, "0")
    text = F.concat(F.lit("Customer "), key, F.lit(" wrote from User"), number, F.lit("@Mail.example.org and user"), number, F.lit("@mail.example.org via 10.2."), (F.col("c_custkey") % 256).cast("string"), F.lit(".7; IFSC KKBK0RTGSMI."))
    return _customers(spark, sf_dir).select("c_custkey", F.concat(F.lit("s"), (F.col("c_custkey") % 9).cast("string")).alias("scope_id"), text.alias("text"))


_LETTERS = "letters AS (SELECT c_custkey, 's' || (c_custkey % 9) AS scope_id, lpad((c_custkey % 250)::VARCHAR, 3, '0') AS n, '10.2.' || (c_custkey % 256) || '.7' AS ip FROM customer)"


def pii_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document holds e-mail addresses and IPv4 numbers, and which; patterns that SQL has too."""
    own = pii.detect(F.col("text"), only=("email", "ipv4"))  # whatever other rules find at the same places
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(own).alias("x")).select("document_id", "x.*")
    return f.groupBy("document_id", "rule_id", F.sha2("value", 256).alias("value_sha256")).agg(F.count("*").alias("n"))


PII_VALUES = r"""
WITH e AS (SELECT doc_id AS document_id, 'email' AS rule_id, unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b')) AS v FROM documents),
i AS (SELECT doc_id, 'ipv4', unnest(regexp_extract_all(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b', ' ', 'g'), '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS v FROM documents),
k AS (SELECT * FROM i WHERE len(list_filter(string_split(v, '.'), lambda x: x::INTEGER > 255 OR (x <> '0' AND x[1] = '0'))) = 0)
SELECT document_id, rule_id, sha256(v) AS value_sha256, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM k) GROUP BY ALL
"""


def pii_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the values of each customer's text stand."""
    d = _letters(spark, sf_dir).select("c_custkey", F.explode(pii.detect(F.col("text"))).alias("x"))
    return d.select("c_custkey", "x.type", "x.rule_id", "x.start", "x.end", "x.normalized")


PII_PLACES = f"""
WITH {_LETTERS}, a AS (SELECT *, length('Customer ' || c_custkey || ' wrote from ') AS p FROM letters), m AS (SELECT *, 'user' || n || '@mail.example.org' AS mail FROM a)
SELECT c_custkey, 'email' AS type, 'email' AS rule_id, p::INTEGER AS start, (p + 24)::INTEGER AS "end", mail AS normalized FROM m UNION ALL SELECT c_custkey, 'email', 'email', (p + 29)::INTEGER, (p + 53)::INTEGER, mail FROM m
UNION ALL SELECT c_custkey, 'ip_address', 'ipv4', (p + 58)::INTEGER, (p + 58 + length(ip))::INTEGER, replace(ip, '.', '') FROM m UNION ALL SELECT c_custkey, 'ifsc', 'india_ifsc_format', (p + 58 + length(ip) + 7)::INTEGER, (p + 58 + length(ip) + 18)::INTEGER, 'KKBK0RTGSMI' FROM m
"""


def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' texts masked, their tags left out; how many different tokens there are in each."""
    m = _letters(spark, sf_dir).select("c_custkey", pii.mask(F.col("text"), F.col("scope_id"), SECRET).alias("masked"))
    found = F.regexp_extract_all("masked", F.lit(r"(\[[A-Z]+_[0-9A-F]{10}_[0-9A-F]{10}\])"))
    return m.select("c_custkey", F.regexp_replace("masked", BARE, "]").alias("masked"), F.size(F.array_distinct(found)).alias("n_different"))


PII_MASKED = "SELECT c_custkey, 'Customer ' || c_custkey || ' wrote from [EMAIL] and [EMAIL] via [IP]; IFSC [IFSC].' AS masked, 3 AS n_different FROM customer"


def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are values of each kind in each scope, no token twice."""
    m = _letters(spark, sf_dir).select("scope_id", pii.mask(F.col("text"), F.col("scope_id"), SECRET).alias("masked"))
    tokens = m.select("scope_id", F.explode(F.regexp_extract_all("masked", F.lit(r"(\[[A-Z]+_[0-9A-F]{10}_[0-9A-F]{10}\])"))).alias("token"))
    return tokens.groupBy("scope_id", F.regexp_extract("token", r"\[([A-Z]+)_", 1).alias("kind")).agg(F.countDistinct("token").alias("n"))


PII_ENTITIES = f"WITH {_LETTERS} SELECT scope_id, 'EMAIL' AS kind, count(DISTINCT n) AS n FROM letters GROUP BY scope_id UNION ALL SELECT scope_id, 'IP', count(DISTINCT ip) FROM letters GROUP BY scope_id UNION ALL SELECT scope_id, 'IFSC', 1 FROM letters GROUP BY scope_id"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _letters(spark, sf_dir).select("scope_id", "c_custkey", F.explode(pii.detect(F.col("text"))).alias("x"))
    return pii.pseudonymize_sequential(d.select("scope_id", "c_custkey", "x.*"), SECRET, order=["c_custkey", "start"])


def pii_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the values of each scope by first appearance."""
    return _mapping(spark, sf_dir).select("scope_id", "type", "normalized", F.regexp_extract("token", r"_(\d+)\]$", 1).cast("int").alias("number"))


PII_NUMBERS = f"""
WITH {_LETTERS}, v AS (SELECT scope_id, 'email' AS type, 'user' || n || '@mail.example.org' AS normalized, min(c_custkey) AS k FROM letters GROUP BY ALL UNION ALL SELECT scope_id, 'ip_address', replace(ip, '.', ''), min(c_custkey) FROM letters GROUP BY ALL
  UNION ALL SELECT scope_id, 'ifsc', 'KKBK0RTGSMI', 0 FROM letters GROUP BY ALL)
SELECT scope_id, type, normalized, (row_number() OVER (PARTITION BY scope_id, type ORDER BY k, normalized))::INTEGER AS number FROM v
"""


def pii_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each value of a scope a text with its token, and the values of e-mail addresses put back."""
    m = _mapping(spark, sf_dir)
    texts = m.select("scope_id", "type", "normalized", F.concat(F.lit("to "), "token", F.lit(", and again "), "token").alias("text"))
    back = pii.reconstruct(texts, m, ["email"])
    return back.select("scope_id", "type", "normalized", F.regexp_replace("text", r"_[0-9A-F]{16}_\d+\]", "]").alias("text"))


PII_RESTORED = f"""
WITH {_LETTERS}, v AS (SELECT scope_id, 'email' AS type, 'user' || n || '@mail.example.org' AS normalized, 'User' || n || '@Mail.example.org' AS shown FROM letters GROUP BY ALL UNION ALL SELECT scope_id, 'ip_address', replace(ip, '.', ''), '[IP]' FROM letters GROUP BY ALL UNION ALL SELECT scope_id, 'ifsc', 'KKBK0RTGSMI', '[IFSC]' FROM letters GROUP BY ALL)
SELECT scope_id, type, normalized, 'to ' || shown || ', and again ' || shown AS text FROM v
"""


def pii_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name values, masked for several scopes at once."""
    scopes = F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 3 + 1), lambda k: F.concat(F.lit("s"), k.cast("string")))
    masked = pii.mask_query(F.col("text"), scopes, SECRET)
    return _letters(spark, sf_dir).select("c_custkey", F.regexp_replace(masked, BARE, "]").alias("question"))


PII_QUESTIONS = """
SELECT c_custkey, 'Customer ' || c_custkey || ' wrote from ' || e || ' and ' || e || ' via ' || replace(e, 'EMAIL', 'IP') || '; IFSC ' || replace(e, 'EMAIL', 'IFSC') || '.' AS question
FROM (SELECT c_custkey, rtrim(repeat('[EMAIL] ', (c_custkey % 3 + 1)::INTEGER)) AS e FROM customer)
"""


def pii_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the values of a map masked, its keys and nulls as they were."""
    values = F.create_map(F.lit("text"), F.col("text"), F.lit("plain"), F.lit("nothing here"), F.lit("none"), F.lit(None).cast("string"))
    m = _letters(spark, sf_dir).select("c_custkey", pii.mask_map(values, F.col("scope_id"), SECRET).alias("m"))
    return m.select("c_custkey", F.regexp_replace(F.col("m")["text"], BARE, "]").alias("text"), F.col("m")["plain"].alias("plain"), F.col("m")["none"].alias("none"), F.size("m").alias("n"))


PII_MAPS = "SELECT c_custkey, 'Customer ' || c_custkey || ' wrote from [EMAIL] and [EMAIL] via [IP]; IFSC [IFSC].' AS text, 'nothing here' AS plain, NULL::VARCHAR AS none, 3 AS n FROM customer"


def pii_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a label gives away stand elsewhere without it; what leaks of them, found by a pattern of its own."""
    number = F.concat(F.lit("98450"), F.lpad((F.col("c_custkey") % 100_000).cast("string"), 5, "0"))
    once = F.concat(F.lit("phone: "), number, F.lit(" is mine"))
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(once, F.lit("; call "), number)).otherwise(once)
    d = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("scope_id"), text.alias("text"))
    given = d.select("scope_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b98450\d{5}\b)"))).alias("value"))
    return pii.leaks(d.select("scope_id", pii.mask(F.col("text"), F.col("scope_id"), SECRET).alias("text")), given)


PII_LEFT = "SELECT c_custkey::VARCHAR AS scope_id, '98450' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS value FROM customer WHERE c_custkey % 4 = 0"


def pii_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with three tokens, of which some may not be there."""
    token = lambda n: F.concat(F.lit("[EMAIL_0123456789_"), F.lpad(F.upper(F.hex(n)), 10, "0"), F.lit("]"))
    a = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" or ", token(F.col("c_custkey")), token(F.col("c_custkey") + 1), token(F.col("c_custkey"))).alias("text"), F.array(token(F.col("c_custkey") + F.col("c_custkey") % 2)).alias("allowed"))
    return pii.unknown_tokens(a).select("c_custkey", F.array_join("unknown", " ").alias("unknown"))


PII_UNKNOWN = "SELECT c_custkey, '[EMAIL_0123456789_' || lpad(upper(to_hex(c_custkey + 1 - c_custkey % 2)), 10, '0') || ']' AS unknown FROM customer"


def pii_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their document's mode: the private ones' texts masked for the embedder."""
    d = _letters(spark, sf_dir).select(F.col("c_custkey").alias("document_id"), F.lit("u1").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "privacy_minimised").otherwise("standard").alias("processing_mode"))
    c = _letters(spark, sf_dir).select(F.col("c_custkey").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    p = pii.project_chunks(c, d, SECRET)
    return p.select("document_id", "embedding_projection", F.regexp_replace("embedding_text", BARE, "]").alias("embedding_text"), F.col("provider_safe_content").isNull().alias("unmasked"))


PII_PROJECTION = f"""
WITH {_LETTERS} SELECT c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'privacy_minimised' ELSE 'original' END AS embedding_projection, c_custkey % 2 = 1 AS unmasked,
  CASE WHEN c_custkey % 2 = 0 THEN 'Customer ' || c_custkey || ' wrote from [EMAIL] and [EMAIL] via [IP]; IFSC [IFSC].' ELSE 'Customer ' || c_custkey || ' wrote from User' || n || '@Mail.example.org and user' || n || '@mail.example.org via ' || ip || '; IFSC KKBK0RTGSMI.' END AS embedding_text FROM letters
"""


def document_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' lines as rankings of suppliers."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("document_id"), F.col("l_linenumber").alias("rank"))
    return pii.document_aliases(n)


DOCUMENT_ALIASES = "SELECT query_id, document_id, 'Document ' || row_number() OVER (PARTITION BY query_id ORDER BY r, document_id) AS alias FROM (SELECT l_orderkey AS query_id, 'd' || l_suppkey AS document_id, min(l_linenumber) AS r FROM lineitem GROUP BY ALL)"


def custom_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges by a pattern of the caller's own, which goes before the rules."""
    text = F.concat(F.lit("badge B-"), F.col("c_custkey").cast("string"), F.lit(" of b-"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    d = _customers(spark, sf_dir).select("c_custkey", F.explode(pii.detect(text, (("badge", r"B-\d+"),))).alias("x"))
    return d.select("c_custkey", "x.rule_id", "x.value", "x.start")


CUSTOM_PATTERNS = "SELECT c_custkey, 'custom:badge' AS rule_id, 'B-' || c_custkey AS value, 6 AS start FROM customer UNION ALL SELECT c_custkey, 'email', 'b-' || c_custkey || '@x.org', (12 + length(c_custkey::VARCHAR))::INTEGER FROM customer"


def verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: of the ten last digits after eleven made of a customer's key just one passes, and as the rules in Python say."""
    head = F.concat((F.col("c_custkey") % 8 + 2).cast("string"), F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    n = _customers(spark, sf_dir).select("c_custkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(head, k.cast("string")))).alias("number"))
    found = F.size(pii.detect(F.concat(F.lit("id "), F.col("number")))) > 0
    judged = n.select("c_custkey", pii.is_valid_aadhaar(F.col("number")).alias("valid"), found.alias("found"))
    return judged.groupBy("c_custkey").agg(F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") != F.col("found")).alias("n_apart"))


VERHOEFF = "SELECT c_custkey, 1::BIGINT AS n_valid, 0::BIGINT AS n_apart FROM customer"

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in (
    "pii_values pii_places pii_masked pii_entities pii_numbers pii_restored pii_questions pii_maps pii_left pii_unknown pii_projection document_aliases custom_patterns verhoeff"
).split()}
