"""Every registered query against its SQL formulation on the smallest tables."""

import os
from collections import Counter

import pytest

from pagelore.catalog import all_oracles, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    columns = sorted(df.columns)
    rows = Counter(_plain(r) for r in df.select(*columns).collect())
    sql = all_oracles().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    order = sorted(range(len(columns)), key=lambda i: result.description[i][0])
    assert [result.description[i][0] for i in order] == columns
    assert rows == Counter(_plain([r[i] for i in order]) for r in result.fetchall())


def test_every_formulation_belongs_to_a_query():
    assert set(all_oracles()) <= set(all_queries())
