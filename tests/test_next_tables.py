"""Next tables hold all columns: each is fed to its operator again, and to what reads it."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quillmark.operators import access as A, changes as M, content as C, quality as Q
from quillmark.sources import files as S

MEMBERSHIPS = "id long, organization_id int, connector_id string, source_item_id int, connector_scope_id string, status string, removed_at string, first_discovered_at string, last_seen_at string, note string"
SCOPES = "id string, organization_id int, connector_id string, external_scope_key string, knowledge_space_id int, access_mode string, scope_type string, status string, removed_at string, label string"


def at(day):
    return F.lit(day)


def test_memberships(spark):
    known = spark.createDataFrame([(1, 1, "c", 10, "s", "active", None, "d0", "d0", "kept"), (2, 1, "c", 11, "s", "removed", "d1", "d0", "d0", "back"), (3, 1, "c", 12, "s", "active", None, "d0", "d0", "unseen")], MEMBERSHIPS)
    seen = spark.createDataFrame([(1, "c", 10, "s"), (1, "c", 11, "s"), (1, "c", 13, "s"), (1, "c", 13, "s")], "organization_id int, connector_id string, source_item_id int, connector_scope_id string")
    once = M.upsert_memberships(seen, known, at("d5"))
    assert once.dtypes == known.dtypes
    rows = {r["source_item_id"]: r for r in once.collect()}
    assert len(rows) == once.count() == 4
    assert (rows[11]["status"], rows[11]["removed_at"], rows[11]["id"], rows[11]["note"], rows[11]["last_seen_at"]) == ("active", None, 2, "back", "d5")
    assert (rows[12]["last_seen_at"], rows[13]["connector_id"], rows[13]["first_discovered_at"]) == ("d0", "c", "d5") and rows[13]["id"]
    again = M.upsert_memberships(seen, once, at("d6"))
    assert {(r["id"], r["source_item_id"], r["first_discovered_at"]) for r in again.collect()} == {(r["id"], r["source_item_id"], r["first_discovered_at"]) for r in once.collect()}
    scopes = spark.createDataFrame([("s", 1, "c", "k", 5, "hybrid", "folder", "active", None, "x")], SCOPES)
    live = lambda *ids: spark.createDataFrame([(1, i, "active", None) for i in ids], "organization_id int, id int, status string, deleted_at string")
    connectors = spark.createDataFrame([(1, "c", "active")], "organization_id int, id string, status string")
    items = live(10, 11, 12, 13).withColumn("connector_id", F.lit("c")).withColumn("source_item_type", F.lit("file"))
    paths = A.scope_paths(once, scopes, connectors, live(5), items)
    assert sorted(r["source_item_id"] for r in paths.collect()) == [10, 11, 12, 13]


def test_scopes(spark):
    known = spark.createDataFrame([("a", 1, "c", "k1", 5, "hybrid", "folder", "active", None, "x"), ("b", 1, "c", "k2", 5, "hybrid", "folder", "removed", "d1", "y"), ("d", 1, "c", "k3", 5, "hybrid", "folder", "active", None, "z"), ("e", 1, "other", "k1", 5, "hybrid", "folder", "active", None, "w"), ("f", 1, "c", "k4", 5, "hybrid", "folder", "active", None, "v")], SCOPES)
    chosen = spark.createDataFrame([(1, "c", "k1", 5, "source_acl", "folder"), (1, "c", "k2", 5, None, "folder"), (1, "c", "k4", 6, "source_acl", "folder"), (1, "c", "new", 7, "platform_managed", "repository")], "organization_id int, connector_id string, external_scope_key string, knowledge_space_id int, access_mode string, scope_type string")
    after = M.upsert_scopes(chosen, known, at("d9"))
    assert after.columns == [*known.columns, "outcome"]
    rows = {(r["connector_id"], r["external_scope_key"]): r for r in after.collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {("c", "k1"): "kept", ("c", "k2"): "restored", ("c", "k3"): "removed", ("c", "k4"): "conflict", ("other", "k1"): "untouched", ("c", "new"): "created"}
    assert (rows["c", "k1"]["access_mode"], rows["c", "k2"]["access_mode"], rows["c", "k2"]["removed_at"], rows["c", "k2"]["label"]) == ("source_acl", "hybrid", None, "y")
    assert (rows["c", "k3"]["status"], rows["c", "k3"]["removed_at"], rows["c", "k3"]["id"]) == ("removed", "d9", "d")
    assert (rows["c", "k4"]["knowledge_space_id"], rows["c", "k4"]["access_mode"]) == (5, "hybrid")
    new = rows["c", "new"]
    assert new["id"] and (new["status"], new["access_mode"], new["scope_type"], new["knowledge_space_id"]) == ("active", "platform_managed", "repository", 7)
    again = M.upsert_scopes(chosen, after.drop("outcome"), at("d10"))
    assert {(r["id"], r["outcome"]) for r in again.collect()} == {("a", "kept"), ("b", "kept"), ("d", "untouched"), ("e", "untouched"), ("f", "conflict"), (new["id"], "kept")}


def test_index_states(spark):
    versions = spark.createDataFrame([(1, 7, True), (1, 8, False), (1, 9, True)], "organization_id int, id long, is_current boolean")
    states = spark.createDataFrame([(70, 1, 7, "p", "m", 64, 2, 2, "indexed", "new_version", 1, None)], "id long, organization_id int, document_version_id long, profile_fingerprint string, embedding_model string, embedding_dimensions int, desired_generation long, indexed_generation long, status string, reason string, attempt_count int, next_retry_at date")
    once = M.ensure_index_state(versions, states, "p", "m", 64)
    assert once.dtypes == states.dtypes
    rows = {r["document_version_id"]: r for r in once.collect()}
    assert set(rows) == {7, 9} and rows[7]["id"] == 70 and (rows[9]["embedding_model"], rows[9]["embedding_dimensions"], rows[9]["reason"], rows[9]["status"], rows[9]["desired_generation"]) == ("m", 64, "new_version", "pending", 1)
    assert sorted(map(tuple, M.ensure_index_state(versions, once, "p", "m", 64).collect())) == sorted(map(tuple, once.collect()))
    other = M.ensure_index_state(versions, once, "q", "m2", 128, "profile_changed")
    assert other.count() == 4 and other.select("id").distinct().count() == 4
    done = M.mark_indexed(M.advance_index_state(other, spark.createDataFrame([(rows[9]["id"], 3)], "id long, generation long")), spark.createDataFrame([(rows[9]["id"],)], "id long"))
    assert done.filter(F.col("id") == rows[9]["id"]).select("indexed_generation", "status").first() == (3, "indexed")


def test_chunks_take_time_in_proportion():
    text = "word " * 400_000
    began = time.perf_counter()
    assert sum(1 for _ in C.chunk_text(text)) > 1000
    short = time.perf_counter() - began
    began = time.perf_counter()
    n = sum(1 for _ in C.chunk_text(text * 4))
    assert n > 4000 and time.perf_counter() - began < 8 * short + 1


def test_sections_of_odd_texts(spark):
    cases = {1: "# A\r\nbody\r\n## \r\n#x\n####### y\n  ### B ###  \nlast", 2: None, 3: "", 4: "no heading", 5: "# Only", 6: "\n\n # T \n\n# U\n $1 \\x\n", 7: "pre\n# H\n\n# G\nend"}
    rows = C.markdown_sections(spark.createDataFrame(list(cases.items()), "doc_id int, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["section_index"])):
        got.setdefault(r["doc_id"], []).append((r["heading"], r["text"]))
    assert got == {1: [("A", "body\n## \n#x\n####### y"), ("B ###", "last")], 4: [(None, "no heading")], 5: [(None, "# Only")], 6: [("U", "$1 \\x")], 7: [(None, "pre"), ("G", "end")]}
    titles = C.markdown_titles(spark.createDataFrame([(i, t, "stem") for i, t in cases.items()], "doc_id int, text string, stem string")).collect()
    assert {r["doc_id"]: (r["title"], r["heading_count"]) for r in titles} == {1: ("A", 2), 2: ("stem", 0), 3: ("stem", 0), 4: ("stem", 0), 5: ("Only", 1), 6: ("T", 2), 7: ("H", 2)}


def test_trees_by_doubling(spark, monkeypatch):
    written = []
    monkeypatch.setattr(S, "cut", lambda df, own=S.cut: written.append(1) or own(df))
    # a chain of 70 trees with a file each, and one subtree that stands in two places
    chain = [(i, "d", i + 1, "040000", "tree", None) for i in range(70)] + [(i, "f", 1000 + i, "100644", "blob", 5) for i in range(70)]
    shared = [(100, "a", 102, "040000", "tree", None), (100, "b", 102, "040000", "tree", None), (102, "x", 1, "100644", "blob", 1)]
    entries = spark.createDataFrame(chain + shared, "parent_tree_id long, name string, object_id long, mode string, object_type string, size_bytes long")
    roots = spark.createDataFrame([(0,), (100,)], "root_tree_id long")
    rows = S.expand_tree(entries, roots).collect()
    files = {(r["root_tree_id"], r["path"], r["depth"]) for r in rows if r["object_type"] == "blob"}
    assert files == {(0, "d/" * i + "f", i + 1) for i in range(64)} | {(100, "a/x", 2), (100, "b/x", 2)}
    assert len(written) <= 1 + 6 and len(rows) == len({(r["root_tree_id"], r["path"]) for r in rows}) == 64 + 64 + 4
    loop = spark.createDataFrame([(0, "d", 0, "040000", "tree", None)], entries.schema)
    assert S.expand_tree(loop, roots, 8).count() == 8


def test_json_faults_have_paths(spark):
    cases = {1: '{"a": [{"To\\u006ben": {"x": "/etc"}}], "b": "Bearer x"}', 2: '["ok", "C:\\\\x", ["password=1"]]', 3: '"/abs"', 4: "not json but password=1", 5: None, 6: '{"note": "a traceback"}', 7: "{}", 8: '{"path": "/x", "deep": {"deep": {"deep": {"secret": null}}}}', 9: "7"}
    df = spark.createDataFrame(list(cases.items()), "n int, j string")
    got = {(r["n"], r["path"], r["fault"]) for r in Q.json_faults(df, "n", "j").collect()}
    assert got == {
        (1, "$.a[0].Token", "key"), (1, "$.a[0].Token.x", "value"), (1, "$.b", "value"), (2, "$[1]", "value"), (2, "$[2][0]", "value"), (3, "$", "value"), (4, None, "text"),
        (8, "$.path", "key"), (8, "$.path", "value"), (8, "$.deep.deep.deep.secret", "key"),
    }
    unsafe = {r["n"] for r in Q.scan_unsafe_json(df, "j").filter("unsafe").collect()}
    assert unsafe == {n for n, _, _ in got}
    assert Q.json_faults(df.limit(0), "n", "j").count() == 0
