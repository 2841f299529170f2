"""File names, kinds, uploads and object paths as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_letters

# Extension -> kind, and what each kind may be declared as and how large it may be (bytes).
KINDS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "csv", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx"}
TYPES = {
    "text": ["text/plain"], "markdown": ["text/markdown", "text/plain", "text/x-markdown"], "html": ["text/html", "application/xhtml+xml"], "csv": ["text/csv", "application/csv", "text/plain", "application/vnd.ms-excel"],
    "pdf": ["application/pdf"], "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
}
ANY_TYPE = ["", "application/octet-stream"]
MEGABYTE = 1024 * 1024
MOST_BYTES = {"text": 5 * MEGABYTE, "markdown": 5 * MEGABYTE, "html": 5 * MEGABYTE, "csv": 10 * MEGABYTE, "pdf": 15 * MEGABYTE, "docx": 15 * MEGABYTE, "xlsx": 10 * MEGABYTE}
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304"}
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"


def extension(name: Column) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.trim(name), r"(\.[A-Za-z0-9]+)$", 1))


def kind(name: Column) -> Column:
    """Null for a file of no known kind."""
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[extension(name)]


def base(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\.[A-Za-z0-9]+$", "")


def validate_upload(name: Column, size: Column, mime: Column, most: int = 15 * MEGABYTE) -> Column:
    """Struct of status (200 if all is well) and error, by the first rule that is broken."""
    known, limit = kind(name), F.create_map(*[F.lit(x) for pair in MOST_BYTES.items() for x in pair])
    plain = F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), "^[^;]*", 0)))
    fits = plain.isin(ANY_TYPE)
    for k, allowed in TYPES.items():
        fits = fits | ((known == k) & plain.isin(allowed))
    answer = lambda status, error: F.struct(F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, answer(400, "empty_file"))
        .when(size > most, answer(413, "file_too_large"))
        .when(extension(name).isin(".xls", ".xlsm"), answer(415, "legacy_workbook"))
        .when(known.isNull(), answer(415, "unsupported_type"))
        .when(~fits, answer(415, "mime_mismatch"))
        .when(size > limit[known], answer(413, "kind_too_large"))
        .otherwise(answer(200, None))
    )


def content_mismatch(content: Column, name: Column) -> Column:
    """Whether a file's first bytes deny its kind: a binary kind without its mark, or a text kind with one."""
    known, head = kind(name), F.hex(F.substring(content, 1, 4))
    wrong = F.lit(False)
    for k, magic in MAGIC.items():
        wrong = wrong | ((known == k) & (head != magic))
    return F.coalesce(wrong | (~known.isin(list(MAGIC)) & head.isin(list(MAGIC.values()))), F.lit(False))


def control_share(content: Column, sample: int = 8192) -> Column:
    """The share of control bytes (without tab, line feed and carriage return) among a file's first ones."""

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        control = bytes(x for x in range(32) if x not in (9, 10, 13))
        for values in batches:
            yield values.map(lambda x: 0.0 if not x else 1 - len(bytes(x[:sample]).translate(None, control)) / len(x[:sample]))

    return share(content)


def looks_binary(content: Column, sample: int = 8192, share: float = 0.02) -> Column:
    return control_share(content, sample) >= share


def safe_filename(name: Column, most: int = 120) -> Column:
    """For use in a path: plain letters, digits, dots, hyphens and underscores."""
    flat = F.regexp_replace(F.lower(plain_letters(F.regexp_replace(name, r"^.*[\\/]", ""))), "[^a-z0-9._-]+", "-")
    clean = F.regexp_replace(F.regexp_replace(flat, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(clean == "", "document").otherwise(F.substring(clean, 1, most))


def display_filename(name: Column, most: int = 180) -> Column:
    """As it is shown: without folders and control characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), "[\x00-\x1f\x7f]", ""), r"\s+", " "))
    return F.when(clean == "", "Untitled document").otherwise(F.substring(clean, 1, most))


def parse_path(path: Column) -> Column:
    """user, collection, document and name of a path of four parts; null for others."""
    parts = F.split(path, "/")
    whole = F.struct(*[parts[k].alias(x) for k, x in enumerate(("user_id", "collection_id", "document_id", "name"))])
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p == ""), whole)


def owned_by(path: Column, user: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), 1) == user, F.lit(False))


def validate_object_path(path: Column, identifier: str = UUID) -> Column:
    """Null for an exact object path, else why it isn't one. identifier: the form of ids."""
    parts = F.split(path, "/")
    exact = rf"^{identifier}/{identifier}/(?:{identifier}-[A-Za-z0-9_.-]+|{identifier}/[A-Za-z0-9_.-]+)$"
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "EMPTY_PATH")
        .when(path.startswith("/") | path.endswith("/"), "ROOT_OR_FOLDER_PATH")
        .when(path.rlike(r"[\\*?\[\]{}\x00-\x1f\x7f]"), "WILDCARD_OR_UNSAFE_PATH")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "PATH_TRAVERSAL")
        .when(~F.size(parts).isin(3, 4), "PATH_PREFIX_OR_DEPTH")
        .when(~path.rlike(exact), "MALFORMED_OWNERSHIP_PATH")
    )


def fingerprint(path: Column) -> Column:
    return F.sha2(path, 256)


def candidate_id(path: Column, project: str, bucket: str) -> Column:
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat(F.lit(f"{project}:{bucket}:"), path), 256), 1, 24))


def canonical_json(value: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
