"""All queries of the library, and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "lexical_topk"
AREAS = ("ingest", "retrieval", "operations", "evidence", "reading", "privacy", "answers", "streams")


def _all() -> dict:
    found: dict = {}
    for area in AREAS:
        found |= import_module(f".plans.{area}", __package__).QUERIES
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
