"""Every registered query with SQL gives the same rows as another engine on the same tables."""

import os

import duckdb
import pytest

from tesserakit.jobs import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_same_rows(spark, other, name):
    got = catalog.QUERIES[name](spark, SF)
    want = other.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
