"""The driver's contract, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from graniva.plans import core_queries

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core_queries.queries()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "avg_stars"] and 0 < df.count() <= 10


@needs_data
@pytest.mark.parametrize("name", ["top10_items", "cf_reference_mode", "p4_found", "p5_leaves", "components"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(FOLDER).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    df = entry.queries()[name](spark, FOLDER)
    r = c.sql(entry.oracle_sql()[name])
    at = [r.columns.index(x) for x in df.columns]
    assert sorted(map(repr, (tuple(x) for x in df.collect()))) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
