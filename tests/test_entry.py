"""Every query against its SQL on the smallest tables; those without SQL must run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakescribe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if not isinstance(x, int | str | bool | type(None)) else x


def _rows(table, columns):
    return sorted((tuple(map(_plain, r)) for r in zip(*[table[c].to_pylist() for c in columns], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    table = found.select(*columns).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert table.num_rows > 0
        return
    want = duck.execute(sql).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert _rows(table, columns) == _rows(want, columns)


def test_entry_lists(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
