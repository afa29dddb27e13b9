"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import duck, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_rows_equal_sql(spark, name):
    found = entry.core.QUERIES[name](spark, FOLDER)
    columns, rows = duck(FOLDER, entry.core.SQL[name])
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, rows)


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES) - set(entry.core.SQL)))
def test_others_run(spark, name):
    assert entry.core.QUERIES[name](spark, FOLDER).columns


def test_entry_has_all_types(spark):
    assert {r.answer_type for r in entry.entry(spark).select("answer_type").distinct().collect()} >= {"all", "paragraph"}
