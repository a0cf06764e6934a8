"""Pairs of many rows by many rows, dealt over tasks."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark import catalog, storage
from quillmark.operators import access as A

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(storage, "CELL_PAIRS", 20)
    monkeypatch.setattr(storage, "TASK_PAIRS", 100)


def test_a_hot_value_is_dealt_and_no_pair_is_lost(spark, small_cells):
    left = spark.range(200).select(F.when(F.col("id") < 180, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(100).select(F.when(F.col("id") < 90, 1).otherwise(F.col("id") + 100).alias("k"), F.col("id").alias("b"))
    out = storage.paired(left, right, ["k"], "a", "b")
    assert out.columns == ["k", "a", "b"]
    # 180 by 90 rows of one value, and 10 by 1 of others
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    in_tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(in_tasks) > 50 and max(in_tasks) < 1500


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["granted_spaces", "acl_allowed", "authorized_paths"])
def test_cells_change_no_result(spark, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    monkeypatch.setattr(storage, "CELL_PAIRS", 500)
    monkeypatch.setattr(storage, "TASK_PAIRS", 40)
    monkeypatch.setattr(storage, "PAIR_TASKS", 6)
    got = catalog.queries()[name](spark, str(DATA))
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
    spark.catalog.clearCache()


def test_only_grants_of_wanted_spaces_meet_users(spark):
    users = spark.createDataFrame([(1, 7, "active"), (1, 8, "active")], "organization_id int, id int, status string")
    grant = "organization_id int, {} int, knowledge_space_id int, granted_at date, expires_at date, revoked_at date"
    rows = lambda unit, *pairs: spark.sql("select * from values " + ", ".join(f"(1, {u}, {s}, date'2020-01-01', cast(null as date), cast(null as date))" for u, s in pairs) + f" as t(organization_id, {unit}, knowledge_space_id, granted_at, expires_at, revoked_at)")
    empty = lambda unit: spark.createDataFrame([], grant.format(unit))
    held = lambda unit: spark.createDataFrame([], f"organization_id int, {unit} int, user_id int, status string, effective_from date, expires_at date, revoked_at date")
    units = spark.createDataFrame([], "organization_id int, id int, status string")
    grants = {"user": rows("user_id", (7, 100), (7, 101), (8, 102)), "department": empty("department_id"), "team": empty("team_id")}
    memberships = {"department": held("department_id"), "team": held("team_id")}
    wanted = spark.createDataFrame([(1, 101), (1, 102)], "organization_id int, knowledge_space_id int")
    found = A.named_grants(users, grants, memberships, {"department": units, "team": units}, F.expr("date'2021-01-01'"), wanted)
    assert sorted(map(tuple, found.collect())) == [(1, 7, 101), (1, 8, 102)]
