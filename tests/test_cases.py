"""Small literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.functions import predicates as P, scalars as X
from quillmark.operators import access as A, content as C, history as H, quality as Q
from quillmark.sources import files as S
from quillmark.streaming import streams as ST
from quillmark.streaming.log import DocumentLog


def test_chunks_break_at_the_strongest_boundary():
    assert [b - a for a, b in C.chunk_text("x" * 31, 10, 2)] == [10, 10, 10, 7]
    cut = lambda t, n: t[slice(*next(C.chunk_text(t, n, 0)))]
    assert cut("one two.\n\nthree four five", 18) == "one two."
    assert cut("one two.\nthree four five", 18) == "one two."
    assert cut("one two. three four five", 18) == "one two."
    assert cut("one two three four five", 18) == "one two three"
    assert list(C.chunk_text("  \n ", 10, 2)) == []


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "a\r\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["content"]) for r in C.chunk_documents(docs).collect()] == [(1, "a\nb")]


def test_access_modes(spark):
    paths = spark.createDataFrame([(1, i, f"s{i}", 5, "c", mode) for i, mode in enumerate(["platform_managed", "source_acl", "hybrid"] * 3)], "organization_id int, source_item_id int, connector_scope_id string, knowledge_space_id int, connector_id string, access_mode string")
    granted = spark.createDataFrame([(1, 7, 5)], "organization_id int, user_id int, knowledge_space_id int")
    acl = "organization_id int, connector_id string, source_item_id int, user_id int"
    allowed = spark.createDataFrame([(1, "c", i, u) for i in range(3, 9) for u in (7, 8)], acl)
    denied = spark.createDataFrame([(1, "c", i, 7) for i in range(6, 9)], acl)
    got = {(r["user_id"], r["source_item_id"]) for r in A.authorized_paths(paths, granted, allowed, denied).collect()}
    assert got == {(7, 0), (7, 3), (7, 6), (7, 4), (7, 5), (8, 4), (8, 7)}


def test_groups_are_closed_once(spark):
    own = spark.createDataFrame([(1, 7, "c", "u"), (1, 8, "c", "v")], "organization_id int, user_id int, connector_id string, principal_id string")
    pairs = [("child", "u"), ("parent", "child"), ("child", "parent"), ("g0", "v")] + [(f"g{2 * i + k}", m) for i in range(1, 7) for k in (0, 1) for m in ([f"g{2 * i - 2}", f"g{2 * i - 1}"] if i > 1 else ["g0"])]
    edges = spark.createDataFrame([(1, "c", g, m) for g, m in pairs], "organization_id int, connector_id string, group_principal_id string, member_principal_id string")
    groups = spark.createDataFrame([(1, "c", g, "group", "active") for g in {g for g, _ in pairs}], "organization_id int, connector_id string, id string, principal_type string, lifecycle string")
    got = {(r["user_id"], r["principal_id"]): r["depth"] for r in A.group_closure(own, edges, groups).collect()}
    assert got == {(7, "child"): 1, (7, "parent"): 2, (8, "g0"): 1} | {(8, f"g{2 * i + k}"): i + 1 for i in range(1, 7) for k in (0, 1)}
    near = {(r["user_id"], r["principal_id"]) for r in A.group_closure(own, edges, groups, depth=3).collect()}
    assert near == {k for k, d in got.items() if d <= 3}


def test_budget_batches_restart(spark):
    rows = spark.createDataFrame([(1, i, b, 1, False) for i, b in enumerate([6, 6, 3, 9, 2, 1])] + [(2, i, b, 1, False) for i, b in enumerate([6, 20, 1])] + [(3, 0, 99, 1, True)], "run_id long, place long, bytes long, chunks long, skipped boolean")
    got = {(r["run_id"], r["place"]): (r["batch"], r["refused"]) for r in H.budget_batches(rows, files=2, total_bytes=10, chunks=100).collect()}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    assert [got[2, i] for i in range(3)] == [(0, None), (None, "over_limit"), (None, "after_refusal")] and got[3, 0] == (0, None)


def brute_batches(rows, files, total, chunks):
    """The longest prefix by trying all lengths, then the next."""
    out, at, batch = {}, 0, 0
    while at < len(rows):
        best = 0
        for n in range(1, len(rows) - at + 1):
            part = rows[at : at + n]
            if n <= files and sum(0 if s else b for _, b, _, s in part) <= total and sum(c for _, _, c, _ in part) <= chunks:
                best = n
        if not best:
            out |= {p: None for p, *_ in rows[at:]}
            break
        out |= {p: batch for p, *_ in rows[at : at + best]}
        at, batch = at + best, batch + 1
    return out


def test_budget_batches_against_brute_force(spark):
    import random

    random.seed(5)
    rows = [(run, place, random.randint(0, 9), random.randint(1, 4), random.random() < 0.3) for run in range(12) for place in range(random.randint(1, 25))]
    df = spark.createDataFrame(rows, "run_id long, place long, bytes long, chunks long, skipped boolean").repartition(3)
    got = {(r["run_id"], r["place"]): r["batch"] for r in H.budget_batches(df, 4, 15, 9).collect()}
    for run in range(12):
        want = brute_batches([x[1:] for x in rows if x[0] == run], 4, 15, 9)
        assert {p: got[run, p] for p in want} == want
    small = {(r["run_id"], r["place"]): r["batch"] for r in H.budget_batches(df, 4, 8, 3).collect()}
    for run in range(12):
        want = brute_batches([x[1:] for x in rows if x[0] == run], 4, 8, 3)
        assert {p: small[run, p] for p in want} == want


def brute_chunks(text, size, overlap):
    """Boundaries by looking at every place."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, at, n = [], 0, len(text)
    while True:
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            return out
        limit = at + size
        end = n
        if limit < n:
            inside = text[:limit]
            kinds = [set(), set(), set(), set()]
            for i in range(at, limit):
                if inside[i] == "\n":
                    kinds[1].add(i + 1)
                    j = i + 1
                    while j < limit and inside[j].isspace() and inside[j] != "\n":
                        j += 1
                    if j < limit and inside[j] == "\n":
                        j += 1
                        while j < limit and inside[j].isspace():
                            j += 1
                        kinds[0].add(j)
                if inside[i] in ".!?" and i + 1 < limit and inside[i + 1].isspace():
                    kinds[2].add(i + 1)
                if i > at and inside[i].isspace():
                    kinds[3].add(i)
            end = next((max(k) for k in kinds if k), limit)
        while end > at and text[end - 1].isspace():
            end -= 1
        if end <= at:
            end = limit
            while text[end - 1].isspace():
                end -= 1
        out.append((at, end))
        if end >= n:
            return out
        at = max(end - overlap, at + 1)


def test_chunks_against_brute_force(spark):
    import random

    random.seed(9)
    texts = ["".join(random.choices(["word", "a", ".", "! ", "\n", "\n\n", " ", "\r\n", "\u00e9", "?"], k=60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.chunk_documents(docs, size=30, overlap=6).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["start_offset"], r["end_offset"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_chunks(t, 30, 6), ascii(t)


def test_keyset_pages(spark):
    df = spark.range(10).select((F.col("id") / 4).cast("int").alias("a"), "id")
    page, more, cursor = H.page_of(H.keyset_page(df, ["a", "id"], None, 4), ["a", "id"], 4)
    assert [r["id"] for r in page] == [0, 1, 2, 3] and more and cursor == (0, 3)
    page, more, cursor = H.page_of(H.keyset_page(df, ["a", "id"], (2, 7), 4), ["a", "id"], 4)
    assert [r["id"] for r in page] == [8, 9] and not more and cursor is None
    with pytest.raises(ValueError):
        H.keyset_page(df, ["id"], None, 0)


def test_next_run_and_filters(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS a, TIMESTAMP '2024-01-01 01:00:00' AS n").select(X.next_run(F.col("a"), F.lit(1800), F.col("n")).alias("x"), X.next_run(F.col("n"), F.lit(1800), F.col("a")).alias("y")).first()
    assert (row["x"].hour, row["x"].minute) == (1, 30) and row["y"].hour == 1
    with pytest.raises(ValueError):
        P.only_ids(spark.range(3), "id", [])
    assert P.only_ids(spark.range(3), "id", None).count() == 3


def test_zero_vectors_come_last(spark):
    from quillmark.operators import search

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, embedding array<float>")
    assert [r["id"] for r in search.vector_topk(df, [1.0, 0.0], 4).collect()] == [2, 3, 1, 4]


def test_batch_search_by_blocks(spark, monkeypatch):
    import numpy as np

    from quillmark.operators import search

    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float).tolist()  # many equal ones, some without length
    chunks = spark.createDataFrame([(i % 2, i, v, "m") for i, v in enumerate(vectors)] + [(0, 90, [1.0, 2.0], "m"), (0, 91, None, "m")], "organization_id int, id long, embedding array<float>, embedding_model string")
    asks = spark.createDataFrame([(i % 2, i, v, "m") for i, v in enumerate(rng.integers(-2, 3, (15, 4)).astype(float).tolist())], "organization_id int, user_id int, query array<float>, embedding_model string")
    want = {}
    for a in asks.collect():
        near = []
        for c in chunks.filter("embedding is not null").collect():
            if c["organization_id"] == a["organization_id"]:
                x, y = np.array(a["query"]), np.array(c["embedding"])
                ok = len(x) == len(y) and np.linalg.norm(x) > 0 and np.linalg.norm(y) > 0
                near.append((round(1 - float((x / np.linalg.norm(x)) @ (y / np.linalg.norm(y))), 9) if ok else float("inf"), c["id"]))
        want[a["user_id"]] = [i for _, i in sorted(near)[:7]]
    for blocks in ((8192, 1024), (7, 3)):
        monkeypatch.setattr(search, "CHUNK_BLOCK", blocks[0])
        monkeypatch.setattr(search, "REQUEST_BLOCK", blocks[1])
        got = {}
        for r in search.vector_topk_batch(chunks, asks, 7).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append(r["chunk_id"])
        assert got == want
        pairs = chunks.filter("embedding is not null").withColumnRenamed("id", "chunk_id").join(asks, ["organization_id", "embedding_model"])
        one = {}
        for r in search.rank_by_distance(pairs, ["user_id"], 7).orderBy("user_id", "rank").collect():
            one.setdefault(r["user_id"], []).append(r["chunk_id"])
        assert one == want


def test_tree_collisions(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "a"), (1, "b"), (2, "x"), (2, "x"), (3, "\u00e9"), (3, "e\u0301")], "parent_tree_id long, name string")
    got = {r["parent_tree_id"]: (r["n_duplicates"], r["n_collisions"], r["accepted"]) for r in Q.check_tree(rows).collect()}
    assert got == {1: (0, 1, False), 2: (1, 0, False), 3: (0, 1, False)}


def test_scan_files_and_stream(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "b.MD").write_text("# Hi\nthere")
    (root / "sub" / "a.txt").write_text("plain words")
    (root / "sub" / "c.bin").write_bytes(b"\xff")
    files = S.scan_files(spark, str(root), [".md", ".txt"]).orderBy("key")
    assert [r["key"] for r in files.collect()] == ["b.MD", "sub/a.txt"]
    assert [r["key"] for r in S.scan_files_after(files, "b.MD").collect()] == ["sub/a.txt"]
    assert {r["title"]: r["rejected"] for r in C.read_text(files).collect()} == {"b": None, "a": None}
    (root / "sub" / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "blank.txt").write_text(" \n")
    assert {r["title"]: r["rejected"] for r in C.read_text(S.scan_files(spark, str(root), [".txt"])).collect()} == {"a": None, "bad": "not_utf8", "blank": "blank"}
    got = []
    query = ST.ingest_stream(spark, str(root), str(tmp_path / "checkpoint"), lambda df, n: got.extend(df.collect()), "*.txt")
    query.awaitTermination(60)
    assert [(r["content"], r["title"]) for r in got] == [("plain words", "a")]


def test_stream_into_the_catalogue(spark, tmp_path):
    root, place, at = tmp_path / "files", str(tmp_path / "catalogue"), F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    root.mkdir()
    log = DocumentLog(spark, place, buckets=2)
    run = lambda: ST.ingest_stream(spark, str(root), str(tmp_path / "checkpoint"), ST.delta_sink(log, 3, "local_folder", at), "*.txt").awaitTermination(90)
    (root / "a.txt").write_text("first words")
    run()
    (root / "b.txt").write_text("more words")
    run()
    # a restart goes on where the stream was, with another log over the same folder
    log = DocumentLog(spark, place)
    documents, chunks = log.documents(), log.chunks()
    assert {(r["title"], r["status"], r["organization_id"]) for r in documents.collect()} == {("a", "ready", 3), ("b", "ready", 3)}
    assert {r["chunk_text"] for r in chunks.collect()} == {"first words", "more words"} and chunks.join(documents, chunks["document_id"] == documents["id"]).count() == 2
    log.compact()
    (root / "c.txt").write_text("last words")
    run()
    assert log.documents().count() == log.chunks().count() == 3 and log.catalogue.read("documents").count() == 2
    assert sorted(p.name for p in (tmp_path / "catalogue" / "log" / "documents").glob("batch*")) == ["batch=0", "batch=1", "batch=2"]


def test_silent_workers_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, hour = datetime(2024, 1, 1), timedelta(hours=1)
    for i, rows in enumerate([[(1, t0), (2, t0), (3, t0)], [(2, t0 + 2 * hour), (3, t0 + hour / 2)], [(2, t0 + 4 * hour), (3, t0 + 1.4 * hour)], [(2, t0 + 4.5 * hour)]]):
        spark.createDataFrame(rows, "worker long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    beats = spark.readStream.schema("worker long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    query = ST.silent_workers(beats, 3600).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["worker"], r["last_seen"], r["silent_from"]) for r in spark.table("silent").collect()}
    late = {(1, t0), (2, t0), (2, t0 + 2 * hour), (3, t0 + 1.4 * hour)}
    assert {(w, seen) for w, seen, _ in got} == late and all(b - a == hour for _, a, b in got)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (2, 20)], "organization_id int, id int")
    S.replace_table(df, str(tmp_path), "t")
    S.replace_table(spark.createDataFrame([(2, 21)], df.schema), str(tmp_path), "t")
    assert {(r["organization_id"], r["id"]) for r in S.load_table(spark, str(tmp_path), "t").collect()} == {(1, 10), (2, 21)}
    S.append_history(df, str(tmp_path / "h"))
    S.append_history(df, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4


def test_forms_and_limits(spark):
    row = spark.range(1).select(
        *[X.matches(F.lit(v), k).alias(f"{k}{i}") for i, (k, v) in enumerate([("code", "a" + "b" * 90), ("worker", "-x"), ("worker", "W.1:a"), ("profile", "a:b/c"), ("profile", "A"), ("object_id", "a" * 40), ("slug", "a--b")])],
        X.json_time(F.lit('{"at": "2024-01-02T03:04:05Z"}'), "at").alias("at"), X.json_time(F.lit('{"at": "soon"}'), "at").alias("none"), X.trim_unicode(F.lit("\u00a0 x\u2003")).alias("trimmed"),
    ).first()
    assert list(row)[:7] == [True, False, True, True, False, True, False]
    assert (row["at"].hour, row["none"], row["trimmed"]) == (3, None, "x")
    assert P.check_limit(5, 1, 5) == 5
    for bad in (0, 6, True, 2.0):
        with pytest.raises(ValueError):
            P.check_limit(bad, 1, 5)
    assert P.only_ids(spark.range(5000), "id", list(range(2000))).count() == 2000


def test_merged_cells_count_once(spark):
    cells = [(0, 0, "1"), (0, 1, "2"), (0, 2, "1"), (1, 3, "m"), (1, 3, "m"), (1, 4, " ")]
    rows = [(1, 0, "paragraph", "Heading 2", "Title", []), (1, 1, "table", "", "", cells), (1, 2, "table", "", "", [(0, 0, " ")])]
    df = spark.createDataFrame(rows, "document_id long, block_index int, kind string, style string, text string, cells array<struct<row:int,cell:int,text:string>>")
    assert tuple(C.assemble_blocks(df).first()) == (1, "Title\n\n1 | 2 | 1\nm", 1, 1)


def test_unsafe_json(spark):
    cases = {'{"a": [{"To\\u006ben": 1}]}': True, '{"x": ["/etc"]}': True, '["C:\\\\x"]': True, '"/abs"': True, '{"note": "a traceback (most recent call last)"}': False, '{"n": "-----begin"}': False, '{"a": "x/y", "tokens": 1}': False, '{"n": "Traceback (most recent call last)"}': True, '{"b": "Bearer x"}': True, "not json": False}
    df = spark.createDataFrame(list(cases.items()), "j string, want boolean")
    assert Q.scan_unsafe_json(df, "j").filter("unsafe <> want").collect() == []
