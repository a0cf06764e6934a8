"""Pairs of classes' members: no pair is lost, and what travels grows no faster than the members."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark import storage
from quillmark.operators import access as A, permissions as R


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(storage, "CELL_PAIRS", 20)
    monkeypatch.setattr(storage, "TASK_PAIRS", 100)
    monkeypatch.setattr(storage, "PAIR_TASKS", 8)
    monkeypatch.setattr(storage, "PACKED_KEYS", 50)


def shuffled(df):
    """How many rows the last action of df shuffled, without the steps that were written before."""
    seen, found = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found += node.metrics().get("shuffleRecordsWritten").get().value()
            seen += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_every_pair_of_each_row_comes_once(spark, small_cells, monkeypatch, broadcast_rows):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", broadcast_rows)
    left = spark.range(200).select(F.when(F.col("id") < 150, 1).otherwise(F.col("id") % 3).alias("k"), F.when(F.col("id") != 7, F.col("id")).alias("a"))
    right = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id") % 4).alias("j"), F.concat(F.lit("b"), "id").alias("b"))
    rows = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, None), (0, 3, "z"), (9, 1, "no left"), (1, 9, "no right"), (None, 1, "null")], "k int, j int, v string")
    out = storage.crossed(rows, storage.packed(left, ["k"], "a", 16), storage.packed(right, ["j"], "b", 8), ["k"], ["j"], "a", "b")
    assert out.columns == ["k", "j", "v", "a", "b"]
    known = rows.join(left, "k").join(right, "j").select(out.columns)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, known.collect()), key=repr) and known.count() > 20_000
    nothing = storage.crossed(rows.limit(0), storage.packed(left, ["k"], "a", 16), storage.packed(right, ["j"], "b", 8), ["k"], ["j"], "a", "b")
    assert nothing.collect() == []


def test_arrays_are_short_and_hold_all_keys(spark, small_cells):
    keys = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    rows = storage.packed(keys, ["k"], "a", 16).collect()
    assert max(len(r["a"]) for r in rows) <= 16 and len({(r["k"], r["_p"]) for r in rows}) == len(rows)
    assert sorted((r["k"], a) for r in rows for a in r["a"]) == sorted((i % 2, i) for i in range(1000))


def _people(spark, n):
    return spark.range(n).select(F.lit(1).alias("organization_id"), F.col("id").cast("int").alias("id"), F.lit("active").alias("status"))


def _granted(spark, n):
    """n users and n spaces granted to their organization."""
    columns = "organization_id int, {}knowledge_space_id int, granted_at date, expires_at date, revoked_at date"
    empty = lambda schema: spark.createDataFrame([], schema)
    open_ = spark.range(n).select(F.lit(1).alias("organization_id"), F.col("id").cast("int").alias("knowledge_space_id"), F.expr("date'2020-01-01'").alias("granted_at"), F.expr("cast(null as date)").alias("expires_at"), F.expr("cast(null as date)").alias("revoked_at"))
    grants = {"organization": open_} | {k: empty(columns.format(f"{k}_id int, ")) for k in ("department", "team", "user")}
    held = {k: empty(f"organization_id int, {k}_id int, user_id int, status string, effective_from date, expires_at date, revoked_at date") for k in ("department", "team")}
    units = {k: empty("organization_id int, id int, status string") for k in ("department", "team")}
    return A.granted_spaces(_people(spark, n), grants, held, units, F.expr("date'2021-01-01'"))


def _allowed(spark, n):
    """n users and n items whose lists are open to everyone."""
    at = "organization_id int, connector_id string, "
    items = spark.range(n).select(F.lit(1).alias("organization_id"), F.lit("c").alias("connector_id"), F.col("id").cast("int").alias("source_item_id"), F.lit("l").alias("list_id"))
    lists = R.AccessLists(items, spark.createDataFrame([], at + "list_id string, principal_id string, effect string"), spark.createDataFrame([(1, "c", "l", True, False)], at + "list_id string, allow_all boolean, deny_all boolean"))
    return R.acl_allowed(_people(spark, n), spark.createDataFrame([], "organization_id int, user_id int, connector_id string, principal_id string"), lists)


def _expanded(spark, n):
    """n users of one class and n items of another, of which the first may use the second."""
    users = spark.range(n).select(F.lit(1).alias("organization_id"), F.col("id").alias("user_id"), F.lit("u").alias("user_class"))
    items = spark.range(n).select(F.lit(1).alias("organization_id"), F.col("id").alias("source_item_id"), F.lit("i").alias("item_class"))
    rows = spark.createDataFrame([(1, "u", "i", "s")], "organization_id int, user_class string, item_class string, connector_scope_id string")
    return R.expand(rows, R.ClassAccess(users, items, rows))


@pytest.mark.parametrize("made", [_granted, _allowed, _expanded])
def test_what_travels_is_less_than_the_members(spark, small_cells, made):
    """Before, members travelled to each cell by themselves: copies grew as the pairs."""
    out = made(spark, 300)
    assert len(set(out.collect())) == 300 * 300
    assert shuffled(out) < 2 * 300
