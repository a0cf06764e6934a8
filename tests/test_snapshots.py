"""Committed snapshots: what readers see, what is rewritten and what is read."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmark.operators import changes as M
from quillmark.sources.snapshots import Catalogue

ITEMS = "organization_id int, key string, checksum string, extra int"


def items(spark, n=400, tenants=3):
    return spark.createDataFrame([(i % tenants, f"k{i}", f"c{i}", i) for i in range(n)], ITEMS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def folders(df):
    return {p.split("/_bucket=")[0] for p in df.inputFiles()}


def test_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path))
    assert c.numbers() == [] and c.manifest() == {}
    df = items(spark)
    assert c.replace("items", df, ["organization_id", "key"], buckets=8) == 1
    assert rows(c.read("items")) == rows(df) and c.read("items").schema == df.schema
    one = spark.createDataFrame([(1, "k1", "new", 7), (5, "fresh", "x", None)], ITEMS)
    before = c.manifest()["items"][1]
    assert c.upsert("items", one.limit(1)) == 2
    after = c.manifest()["items"][1]
    assert sum(after[b] != before[b] for b in range(8)) == 1
    want = rows(df.filter("key <> 'k1'").unionByName(one.limit(1)))
    assert rows(c.read("items")) == want and rows(c.read("items", number=1)) == rows(df)
    c.upsert("items", one)
    assert rows(c.read("items", organization_id=5)) == [(5, "fresh", "x", None)]


def test_a_tenant_whose_last_row_went_is_gone(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2)], ITEMS)
    c.replace("items", df, ["organization_id", "key"], buckets=2)
    c.upsert("items", df.limit(0), deleted=df.filter("organization_id = 2"))
    assert rows(c.read("items")) == [(1, "a", "x", 1)]
    c.upsert("items", df.limit(0), deleted=df)
    assert rows(c.read("items")) == [] and c.read("items").columns == df.columns


def test_a_killed_writer_leaves_the_old_table(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path))
    df = items(spark, 50)
    c.replace("items", df, ["organization_id", "key"], buckets=4)
    # data written, no manifest
    c.stage_upsert("items", spark.createDataFrame([(0, "k0", "lost", 0)], ITEMS))
    assert rows(c.read("items")) == rows(df)
    # a manifest without its mark of success
    (tmp_path / "snapshots" / "2").mkdir()
    (tmp_path / "snapshots" / "2" / "part-0.json").write_text('{"table":"items","body":"{}"}')
    assert c.numbers() == [1] and rows(c.read("items")) == rows(df)
    # nothing half written
    broken = df.withColumn("extra", F.when(F.col("key") == "k3", F.raise_error(F.lit("killed"))).otherwise(F.col("extra")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        c.upsert("items", broken)
    assert rows(c.read("items")) == rows(df)
    # the next one goes on behind it
    assert c.upsert("items", spark.createDataFrame([(0, "k0", "kept", 0)], ITEMS)) == 3
    assert (0, "k0", "kept", 0) in rows(c.read("items"))
    time.sleep(0.05)
    gone = c.expire(0)
    assert {"snapshots/1", "snapshots/2"} <= set(gone) and any(x.startswith("data/") for x in gone)
    assert (0, "k0", "kept", 0) in rows(c.read("items")) and c.read("items").count() == 50


def test_tables_change_together(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path))
    a, b = items(spark, 20), items(spark, 10).withColumn("extra", F.lit(1))
    c.commit(c.stage("a", a, ["key"], buckets=2), c.stage("b", b, ["key"], buckets=2))
    new = spark.createDataFrame([(0, "k0", "n", 9)], ITEMS)
    staged = c.stage_upsert("a", new), c.stage_upsert("b", new)
    assert rows(c.read("a")) == rows(a) and rows(c.read("b")) == rows(b)
    assert c.commit(*staged) == 2
    assert c.read("a").filter("checksum = 'n'").count() == c.read("b").filter("checksum = 'n'").count() == 1


STATE = "organization_id int, connector_id string, source_item_key string, source_checksum string, content_checksum string, item_status string, index_status string, indexed_generation int, desired_generation int"
MANIFEST = "organization_id int, connector_id string, source_item_key string, source_checksum string, unsupported boolean"


def crawl(spark, seed, changes):
    rng = random.Random(seed)
    state = [(i % 3, f"c{i % 2}", f"k{i}", f"s{i}", f"s{i}", "active", "indexed", 1, 1) for i in range(600)]
    seen = {r[:3]: [*r[:4], False] for r in state}
    for _ in range(changes):
        key = rng.choice(list(seen))
        kind = rng.randrange(4)
        if kind == 0:
            seen.pop(key)
        elif kind == 1:
            seen[key][3] = "other"
        elif kind == 2:
            seen[key][4] = True
        else:
            seen[0, "c0", f"new{rng.random()}"] = [0, "c0", f"new{rng.random()}", "x", None]
    return state, [tuple(v) for v in seen.values()]


@pytest.mark.parametrize(("seed", "changes", "odd"), [(1, 5, 3), (2, 0, 0), (3, 400, 30)])
def test_changes_by_digests(spark, tmp_path, seed, changes, odd):
    state, seen = crawl(spark, seed, changes)
    rng = random.Random(seed)
    for i in rng.sample(range(len(state)), odd):  # never unchanged, whatever the crawl finds
        state[i] = (*state[i][:5], *rng.choice([("deleted", "indexed", 1, 1), ("active", "failed", 1, 1), ("active", "indexed", 1, 2), ("active", None, None, None)]))
    known, found = spark.createDataFrame(state, STATE), spark.createDataFrame(seen, MANIFEST)
    c = Catalogue(spark, str(tmp_path))
    M.keep_state(c, known, buckets=64)
    got, read = M.classify_by_digests(c, found)
    assert rows(got) == rows(M.classify_changes(found, known))
    # what is read is in proportion to what differs
    files = len(c.read("item_state").inputFiles())
    most = {0: 0, 5: 8 * 3}.get(changes, files)
    assert len(read.inputFiles()) <= most + 1 and files > 100  # a file of the join of leaves counts, too


def test_changes_of_nothing(spark, tmp_path):
    state, seen = crawl(spark, 1, 0)
    known, found = spark.createDataFrame(state[:3], STATE), spark.createDataFrame(seen[:3], MANIFEST)
    c = Catalogue(spark, str(tmp_path))
    M.keep_state(c, known.limit(0), buckets=4)
    assert {r["change_type"] for r in M.classify_by_digests(c, found)[0].collect()} == {"new"}
    M.keep_state(c, known, buckets=4)
    assert {r["change_type"] for r in M.classify_by_digests(c, found.limit(0))[0].collect()} == {"deleted"}
