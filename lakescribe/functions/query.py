"""Column expressions that turn a question into what is searched for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, tokens

# Words that are never searched for.
STOP_WORDS = (
    "a an and are as at be both by compare conclusion csv document docx explain fact facts file for from give grounded handles how "
    "important in is it its listed me of on one or pdf please requires using show that the these this those tell to was way were "
    "what when where which who why with xlsx"
).split()
#: Short names of roles and their long ones; each stands for the other.
ROLES = {"cto": "chief technology officer"}
MOST_TERMS = 24
CODE = r"\b[A-Za-z]{2,}[-_/A-Za-z0-9]*\d[A-Za-z0-9-_/]*\b"
NUMBER = r"\b\d{4,}\b"
PSEUDONYM = r"\[[A-Z][A-Z0-9_]*\]"


def _word(text: Column, phrase: str) -> Column:
    return text.rlike(r"(?i)\b" + r"\s+".join(phrase.split()) + r"\b")


def role_concepts(text: Column, roles: dict[str, str] = ROLES) -> Column:
    """The roles that a text names, by their long names joined by _."""
    return F.array_compact(F.array(*[F.when(_word(text, short) | _word(text, full), F.lit(full.replace(" ", "_"))) for short, full in roles.items()]))


def expand_roles(text: Column, roles: dict[str, str] = ROLES) -> Column:
    """With the other name of each role at the end, where one stands alone."""
    out = text
    for short, full in roles.items():
        has_short, has_full = _word(text, short), _word(text, full)
        out = F.when(has_short & ~has_full, F.concat(out, F.lit(f" {full}"))).when(has_full & ~has_short, F.concat(out, F.lit(f" {short}"))).otherwise(out)
    return out


def useful(terms: Column, stop: Iterable[str] = STOP_WORDS, most: int = MOST_TERMS) -> Column:
    """Distinct terms of two letters or more that aren't stop words, the first so many."""
    return F.slice(F.array_distinct(F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(list(stop)))), 1, most)


def search_terms(text: Column) -> Column:
    return useful(tokens(expand_roles(text)))


def lexical_variants(text: Column) -> Column:
    """The question, or for one that names a role two: with the short name, and with the long one as a phrase."""
    known = F.size(role_concepts(text)) > 0
    kept = F.regexp_extract_all(text, F.lit(f"({PSEUDONYM})"))
    parts = [w for short, full in ROLES.items() for w in (short, *full.split())]
    rest = F.filter(useful(tokens(F.regexp_replace(text, PSEUDONYM, " "))), lambda t: ~t.isin(parts))
    short, full = next(iter(ROLES.items()))
    named = lambda name: F.concat_ws(" ", F.concat(kept, rest, F.array(F.lit(name))))
    one = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(known, F.array(named(short), named(f'"{full}"'))).otherwise(one)


def identifiers(text: Column) -> Column:
    """Codes (letters, then also digits) and then numbers of four digits or more outside codes; each once."""
    codes = F.regexp_extract_all(text, F.lit(f"({CODE})"))
    numbers = F.regexp_extract_all(F.regexp_replace(text, CODE, " # "), F.lit(f"({NUMBER})"))
    return F.array_distinct(F.concat(codes, numbers))


def identifier_head(text: Column) -> Column:
    return F.regexp_extract(text, "^[A-Za-z]{2,}", 0)


def build_clauses(text: Column) -> Column:
    """What is searched for, any of: structs of kind (pseudonym, identifier, phrase, term) and terms, MOST_TERMS at most.

    An identifier is a phrase of its parts. Its letters are no term by themselves, unless they also stand alone.
    """
    quotes = F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"')), normalize), lambda x: x != "")
    kept = F.regexp_extract_all(text, F.lit(f"({PSEUDONYM})"))
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]+"', " "), PSEUDONYM, " ")
    found = identifiers(bare)
    phrases = F.array_distinct(F.filter(F.transform(found, normalize), lambda x: x != ""))
    without = F.regexp_replace(F.regexp_replace(bare, CODE, " "), NUMBER, " ")
    heads = F.filter(F.transform(found, identifier_head), lambda h: h != "")
    alone = F.exists(heads, lambda h: F.array_contains(F.split(F.lower(without), "[^a-z0-9_]+"), F.lower(h)))
    loose = F.when(alone, bare).otherwise(F.regexp_replace(bare, r"\b[A-Za-z]{2,}[-_]?(?=[-_/A-Za-z0-9]*\d)", ""))
    terms = useful(tokens(loose))
    clause = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.split(x, " ").alias("terms"))
    all_of = F.concat(
        F.transform(F.transform(kept, lambda x: normalize(x)), clause("pseudonym")),
        F.transform(phrases, clause("identifier")),
        F.transform(quotes, clause("phrase")),
        F.transform(terms, clause("term")),
    )
    return F.slice(F.array_distinct(all_of), 1, MOST_TERMS)


def term_variants(term: Column) -> Column:
    """The term and its forms without -ies, -ing, -ed and -s; those of two letters or fewer are left out."""
    n = F.length(term)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    forms = F.array(
        term,
        F.when((n > 4) & term.endswith("ies"), F.concat(cut(3), F.lit("y"))),
        F.when((n > 4) & term.endswith("ing"), cut(3)),
        F.when((n > 4) & term.endswith("ed"), cut(2)),
        F.when((n > 3) & term.endswith("s"), cut(1)),
    )
    return F.filter(F.array_distinct(F.array_compact(forms)), lambda x: F.length(x) > 2)
