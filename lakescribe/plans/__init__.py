"""Queries over the given tables, each beside the SQL that gives the same rows."""
