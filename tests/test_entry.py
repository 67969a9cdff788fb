"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_returns_rows(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
