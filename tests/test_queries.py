"""Every registered query against its SQL in another engine, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from evalspark.catalog import all_queries, all_sql

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, engine, name):
    df = all_queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = sorted(tuple(map(comparable, r)) for r in df.select(*columns).collect())
    sql = all_sql().get(name)
    if sql is None:
        assert rows
        return
    result = engine.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(comparable(r[i]) for i in order) for r in result.fetchall())
