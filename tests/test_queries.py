"""Every registered query of the catalogue against DuckDB on the smallest driver tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from quillmark import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, found.fetchall())
    spark.catalog.clearCache()
