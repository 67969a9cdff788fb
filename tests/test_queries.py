"""Every query of the library proper against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from deltaweave.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value if value is None or isinstance(value, (int, str)) else str(value)


def normal(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(row[k]) for k in order]) for row in found)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) > 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cursor.fetchall())
