"""Personal data: detection by patterns and checksums, stable pseudonyms, and checks that none leaks."""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(NamedTuple):
    """pattern finds candidates; group of it is the value; valid says whether a value is one; of overlapping ones the higher priority stays."""

    type: str
    rule_id: str
    pattern: re.Pattern
    priority: int
    valid: Callable[[str], bool] = lambda value: True
    group: int = 0


def _digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def _one_digit(digits: str) -> bool:
    return len(set(digits)) == 1


def passes_luhn_text(value: str) -> bool:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or _one_digit(d):
        return False
    doubled = [sum(divmod(2 * int(x), 10)) for x in d[-2::-2]]
    return (sum(doubled) + sum(map(int, d[-1::-2]))) % 10 == 0


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order 10."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    """Verhoeff's permutation and its powers."""
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([first[x] for x in rows[-1]])
    return rows


PERMUTATIONS = _permutations()


def passes_verhoeff_text(value: str) -> bool:
    d = _digits(value)
    if len(d) != 12 or d[0] in "01" or _one_digit(d):
        return False
    check = 0
    for k, x in enumerate(reversed(d)):
        check = _dihedral(check, PERMUTATIONS[k % 8][int(x)])
    return check == 0


_SENSITIVE = re.compile(r"access[_-]?token|api[_-]?key|auth|authorization|credential|email|key|password|phone|secret|session|signature|token", re.I)


def _sensitive_url(value: str) -> bool:
    try:
        url = urlsplit(value)
        return bool(url.username or url.password or any(_SENSITIVE.search(k) for k, _ in parse_qsl(url.query, keep_blank_values=True)))
    except ValueError:
        return False


def _ipv4(value: str) -> bool:
    return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in value.split("."))


def _account(value: str) -> bool:
    return 9 <= len(_digits(value)) <= 18 and not _one_digit(_digits(value))


def _phone(value: str) -> bool:
    return 10 <= len(_digits(value)) <= 15


_FLAGS = re.I | re.A
# The patterns and priorities of each kind.
RULES = (
    Rule("sensitive_url", "sensitive_url", re.compile(r"\b(https?://[^\s<>\"']*[^\s<>\"'),.;])", _FLAGS), 110, _sensitive_url, 1),
    Rule("email", "email", re.compile(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b", _FLAGS), 90),
    Rule("payment_card", "payment_card_luhn", re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", re.A), 100, passes_luhn_text),
    Rule("ip_address", "ipv4", re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", re.A), 65, _ipv4),
    Rule("ip_address", "ipv6", re.compile(r"(?<![A-F0-9:])(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{0,4}(?![A-F0-9:])", _FLAGS), 65),
    Rule("pan", "india_pan_format", re.compile(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", re.A), 85),
    Rule("aadhaar", "aadhaar_verhoeff", re.compile(r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)", re.A), 95, passes_verhoeff_text),
    Rule("ifsc", "india_ifsc_format", re.compile(r"\b[A-Z]{4}0[A-Z0-9]{6}\b", re.A), 80),
    Rule("bank_account", "bank_account_context", re.compile(r"\b(?:bank\s+)?account(?:\s+(?:number|no\.?))?\s*[:#-]?\s*([0-9][0-9 -]{7,20}[0-9])\b", _FLAGS), 75, _account, 1),
    Rule("phone", "international_phone", re.compile(r"(?<!\w)\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?){2,5}\d{3,4}(?!\w)", re.A), 70, _phone),
    Rule("phone", "phone_context", re.compile(r"\b(?:phone|mobile|telephone|tel)\s*[:#-]?\s*(\+?\d[\d\s().-]{7,20}\d)\b", _FLAGS), 70, _phone, 1),
)
#: What a text must hold for a rule, by its id, to find anything in it.
NEEDS = {
    "sensitive_url": ":",
    "email": "@",
    "payment_card_luhn": r"\d{3}|\d[ -]\d",
    "ipv4": r"\d\.\d",
    "ipv6": ":",
    "india_pan_format": r"\d{3}",
    "aadhaar_verhoeff": r"\d{3}",
    "india_ifsc_format": "[A-Z]{4}0[A-Z0-9]{6}",
    "bank_account_context": r"\d[\d\s().-]{7,20}\d",
    "international_phone": r"\d{3}",
    "phone_context": r"\d[\d\s().-]{7,20}\d",
}
#: A text without any of this has nothing that a rule finds; tested by Spark before Python sees a row.
HINT = "|".join(dict.fromkeys(NEEDS[r.rule_id] for r in RULES))
CUSTOM_PRIORITY = 105
LABELS = {"sensitive_url": "URL", "custom": "CUSTOM", "government_id": "GOVERNMENT_ID", "payment_card": "CARD", "aadhaar": "AADHAAR", "email": "EMAIL", "pan": "PAN", "ifsc": "IFSC", "bank_account": "ACCOUNT", "phone": "PHONE", "ip_address": "IP"}
DETECTION = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("normalized", T.StringType()), T.StructField("rule_id", T.StringType())])
)


def custom_rules(patterns: tuple[tuple[str, str], ...]) -> tuple[Rule, ...]:
    """(id, pattern) pairs; a pattern must not match the empty string."""
    for name, pattern in patterns:
        if not name.strip() or not pattern or re.search(pattern, "") is not None:
            raise ValueError(f"a custom pattern needs an id and must not match the empty string: {name!r}")
    return tuple(Rule("custom", f"custom:{name}", re.compile(pattern), CUSTOM_PRIORITY) for name, pattern in patterns)


def _normal(kind: str, value: str) -> str:
    return value.lower() if kind == "email" else value if kind == "sensitive_url" else re.sub(r"[\s().-]", "", value).upper()


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, str, str, str]]:
    """type, start, end, value, normalized, rule_id of what stands, by place.

    In order of start (then priority, then length) a candidate stays if it overlaps none that stayed; of the first one that
    it overlaps it takes the place if its priority is higher.
    """
    found = []
    for rule in rules:
        for m in rule.pattern.finditer(text):
            value = m[rule.group]
            if value and rule.valid(value):
                found.append((m.start(rule.group), -rule.priority, -len(value), rule, value))
    kept: list[tuple] = []
    for x in sorted(found, key=lambda c: c[:3]):
        rival = next((k for k, y in enumerate(kept) if x[0] < y[0] - y[2] and x[0] - x[2] > y[0]), None)
        if rival is None:
            kept.append(x)
        elif x[1] < kept[rival][1]:
            kept[rival] = x
    kept.sort(key=lambda c: (c[0], c[0] - c[2]))
    return [(r.type, start, start + len(v), v, _normal(r.type, v), r.rule_id) for start, _, _, r, v in kept]


def detect(text: Column, custom: tuple[tuple[str, str], ...] = (), only: tuple[str, ...] | None = None) -> Column:
    """An array of detections; rows without a hint don't reach Python unless there are custom patterns.

    only: ids of the rules to go by; values of the others are neither found nor take the place of these.
    """
    rules = (RULES if only is None else tuple(r for r in RULES if r.rule_id in only)) + custom_rules(custom)

    @F.pandas_udf(DETECTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda x: [] if x is None else find(x, rules))

    hinted = text if custom else F.when(text.rlike(HINT), text)
    return F.when(text.isNotNull(), F.coalesce(run(hinted), F.array().cast(DETECTION)))


def passes_luhn(value: Column) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1+$") & F.call_function("luhn_check", d)


def is_valid_aadhaar(value: Column) -> Column:
    """Verhoeff's check by lookups in two small arrays."""
    d = F.regexp_replace(value, "[^0-9]", "")
    table = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    moved = F.array(*[F.lit(x) for row in PERMUTATIONS for x in row])
    digits = F.transform(F.filter(F.split(F.reverse(d), ""), lambda x: x != ""), lambda x, k: F.element_at(moved, (k % 8) * 10 + x.cast("int") + 1))
    check = F.aggregate(digits, F.lit(0), lambda c, x: F.element_at(table, c * 10 + x + 1))
    return (F.length(d) == 12) & d.rlike("^[2-9]") & ~d.rlike(r"^(\d)\1+$") & (check == 0)


def _tag(secret: bytes, message: str, n: int) -> str:
    return hmac.digest(secret, message.encode(), "sha256").hex()[:n].upper()


#: The tag of a scope, made once for the values that follow one another in it.
_scope_tag = lru_cache(maxsize=10_000)(lambda secret, scope: _tag(secret, f"scope\0{scope}", 10))


def _secret(secret: str) -> bytes:
    if len(secret) < 32:
        raise ValueError("a secret has 32 characters at least")
    return secret.encode()


def pseudonym(kind: str, normalized: str, scope: str, secret: bytes) -> str:
    """[EMAIL_<scope>_<entity>]: the same for the same value in the same scope, and in no other."""
    return f"[{LABELS[kind]}_{_scope_tag(secret, scope)}_{_tag(secret, f'entity\0{scope}\0{kind}\0{normalized}', 10)}]"


def _replaced(text: str, found: list[tuple], token: Callable[[str, str], str]) -> str:
    out, at = [], 0
    for kind, start, end, _, normalized, _ in found:
        out += [text[at:start], token(kind, normalized)]
        at = end
    return "".join(out) + text[at:]


def mask(text: Column, scope: Column, secret: str, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """The text with each detection replaced by its pseudonym in scope (owner/document/id)."""
    key, rules = _secret(secret), RULES + custom_rules(custom)

    @F.pandas_udf("string")
    def run(texts: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _replaced(x, find(x, rules), lambda k, v, s=s: pseudonym(k, v, s, key)) for x, s in zip(texts, scopes, strict=True)], dtype=object)

    return run(text, scope) if custom else F.when(text.rlike(HINT), run(F.when(text.rlike(HINT), text), scope)).otherwise(text)


def scope_id(user: Column, document: Column) -> Column:
    return F.concat(user.cast("string"), F.lit("/document/"), document.cast("string"))


def mask_query(question: Column, scopes: Column, secret: str) -> Column:
    """A question for many scopes: each detection becomes its pseudonyms in all of them, joined by spaces. scopes: array of string."""
    key = _secret(secret)

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _replaced(x, find(x), lambda k, v, s=s: " ".join(pseudonym(k, v, y, key) for y in s)) for x, s in zip(texts, lists, strict=True)], dtype=object)

    return run(question, scopes)


def mask_map(values: Column, scope: Column, secret: str) -> Column:
    """A map of strings with all its values masked."""
    key = _secret(secret)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [None if y is None else _replaced(y, find(y), lambda k, v, s=s: pseudonym(k, v, s, key)) for y in x] for x, s in zip(lists, scopes, strict=True)], dtype=object)

    return F.map_from_arrays(F.map_keys(values), run(F.map_values(values), scope))


def pseudonymize_sequential(detections: DataFrame, secret: str, scope: str = "scope_id", order: list[str] | None = None) -> DataFrame:
    """scope, type, normalized, value, token: [EMAIL_<scope>_001] and on, by first appearance in a scope; a row for each entity.

    detections: scope, type, normalized, value and order columns. The scope's tag is made once a scope.
    """
    key = _secret(secret)

    @F.pandas_udf("string")
    def tag(scopes: pd.Series) -> pd.Series:
        return scopes.map(lambda x: _tag(key, x, 16))

    place = F.struct(*(order or ["start"]))
    first = detections.groupBy(scope, "type", "normalized").agg(F.min(place).alias("_first"), F.min_by("value", place).alias("value"))
    number = F.row_number().over(Window.partitionBy(scope, "type").orderBy("_first", "normalized"))
    tags = first.select(scope).distinct().withColumn("_tag", tag(F.col(scope)))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("type")]
    named = first.withColumn("_n", number).join(tags, scope)
    padded = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return named.select(scope, "type", "normalized", "value", F.concat(F.lit("["), label, F.lit("_"), "_tag", F.lit("_"), padded, F.lit("]")).alias("token"))


def reconstruct(texts: DataFrame, mapping: DataFrame, allowed: list[str], scope: str = "scope_id", text: str = "text") -> DataFrame:
    """texts with the tokens of allowed types put back; no type allowed: unchanged."""
    own = mapping.where(F.col("type").isin(allowed)).groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("token", "value"))).alias("_m"))
    back = F.aggregate("_m", F.col(text), lambda x, m: F.replace(x, m["token"], m["value"]))
    return texts.join(own, scope, "left").withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(back)).drop("_m")


#: Payloads of a scope that one task goes through, about.
PAYLOADS = 20_000


def leaks(payloads: DataFrame, identifiers: DataFrame, scope: str = "scope_id", text: str = "text", most: int = PAYLOADS) -> DataFrame:
    """scope, value of original identifiers that are still in a scope's payloads; must be empty.

    A scope's identifiers become one automaton (Aho-Corasick), and each of its payloads is read once, however many there
    are to look for. Scopes of more than most payloads are shared out, each share with the identifiers. Null and empty
    identifiers, null payloads and null scopes are left out.
    """
    said = payloads.where(F.col(scope).isNotNull() & F.col(text).isNotNull()).select(F.col(scope).alias("_s"), F.col(text).alias("_t"))
    known = identifiers.where(F.col(scope).isNotNull() & (F.col("value") != "")).select(F.col(scope).alias("_s"), F.col("value").alias("_t")).distinct()
    shares = said.groupBy("_s").agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
    spread = shares.where("_n > 1")  # no more of these than payloads by most
    left = known.join(shares, "_s").select("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_share"), F.lit(0).alias("_kind"), "_t")
    share = F.pmod(F.xxhash64("_t"), F.coalesce("_n", F.lit(1))).cast("int")
    right = said.join(spread, "_s", "left").select("_s", share.alias("_share"), F.lit(1).alias("_kind"), "_t")

    def find_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        at, words, ready, seen = None, ahocorasick.Automaton(), False, set()
        for frame in batches:
            for place, part in frame.groupby(["_s", "_share"], sort=False):
                if place != at:
                    if seen:
                        yield pd.DataFrame({"scope": at[0], "value": list(seen)})
                    at, words, ready, seen = place, ahocorasick.Automaton(), False, set()
                for value in part.loc[part["_kind"] == 0, "_t"]:
                    words.add_word(value, value)
                rows = part.loc[part["_kind"] == 1, "_t"]
                if not len(words) or not len(rows):
                    continue
                if not ready:
                    words.make_automaton()
                    ready = True
                for payload in rows:
                    seen.update(value for _, value in words.iter(payload))
        if seen:
            yield pd.DataFrame({"scope": at[0], "value": list(seen)})

    conf = int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(payloads.dtypes)[scope]
    dealt = left.unionByName(right).repartition(conf, "_s", "_share").sortWithinPartitions("_s", "_share", "_kind")
    return dealt.mapInPandas(find_all, f"scope {kind}, value string").select(F.col("scope").alias(scope), "value").distinct()


def unknown_tokens(answers: DataFrame, allowed: str = "allowed", text: str = "text") -> DataFrame:
    """answers with unknown: the pseudonyms in a text that aren't in its allowed ones."""
    return answers.withColumn("unknown", F.array_except(F.regexp_extract_all(F.col(text), F.lit(r"(\[[A-Z][A-Z_]*_[0-9A-F]{10,16}_[0-9A-F]{3,10}\])")), F.coalesce(F.col(allowed), F.array().cast("array<string>"))))


def project_chunks(chunks: DataFrame, documents: DataFrame, secret: str) -> DataFrame:
    """chunks with provider_safe_content, embedding_projection and embedding_text by their document's mode."""
    c = chunks.drop("processing_mode", "user_id").join(documents.select("document_id", "user_id", "processing_mode"), "document_id")
    return projected(c, secret)


def projected(chunks: DataFrame, secret: str) -> DataFrame:
    """project_chunks of chunks that have their document's user_id and processing_mode."""
    private = F.col("processing_mode") == "privacy_minimised"
    masked = mask(F.when(private, F.col("content")), scope_id(F.col("user_id"), F.col("document_id")), secret)
    c = chunks.withColumn("provider_safe_content", masked)
    return c.select("*", F.when(private, "privacy_minimised").otherwise("original").alias("embedding_projection"), F.when(private, F.col("provider_safe_content")).otherwise(F.col("content")).alias("embedding_text"))


def document_aliases(candidates: DataFrame) -> DataFrame:
    """query_id, document_id, alias: Document 1, Document 2 and on, by first appearance in a ranking."""
    first = candidates.groupBy("query_id", "document_id").agg(F.min("rank").alias("_r"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "document_id"))
    return first.select("query_id", "document_id", F.concat(F.lit("Document "), n.cast("string")).alias("alias"))
