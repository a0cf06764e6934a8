"""The document log: what readers see before, during and after compaction, and what a batch writes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quillmark.streaming.log import DocumentLog

KEY = "organization_id int, source_type string, source_document_key string"


def batch(spark, log, number, texts, at="2024-01-01"):
    """texts: {key: (title, chunks)}"""
    documents = spark.createDataFrame([(1, "local_folder", k, title, "-".join(chunks)) for k, (title, chunks) in texts.items()], f"{KEY}, title string, checksum_latest string")
    chunks = spark.createDataFrame([(1, "local_folder", k, i, c) for k, (_, chunks) in texts.items() for i, c in enumerate(chunks)], f"{KEY}, chunk_index int, chunk_text string")
    log.append(number, documents, chunks, F.expr(f"TIMESTAMP '{at} 00:00:00'"))


def seen(log):
    names = {r["id"]: r["source_document_key"] for r in log.documents().collect()}
    return sorted((r["source_document_key"], r["title"], r["status"], str(r["created_at"])[:10]) for r in log.documents().collect()), sorted((names[r["document_id"]], r["chunk_index"], r["chunk_text"]) for r in log.chunks().collect())


def rows_written(spark, place, batch):
    return sum(spark.read.parquet(f"{place}/log/{kind}/batch={batch}").count() for kind in ("documents", "chunks"))


def test_log_and_compaction(spark, tmp_path):
    place = str(tmp_path / "log")
    log = DocumentLog(spark, place, buckets=16)
    assert seen(log) == ([], []) and log.compact() is None
    batch(spark, log, 0, {f"k{i}": (f"t{i}", [f"a{i}", f"b{i}"]) for i in range(40)})
    want = [(f"k{i}", f"t{i}", "ready", "2024-01-01") for i in range(40)], [(f"k{i}", j, f"{c}{i}") for i in range(40) for j, c in enumerate("ab")]
    want = sorted(want[0]), sorted(want[1])
    assert seen(log) == want
    log.compact()
    assert seen(log) == want and log.folded() == 0 and log.compact() is None
    # one file: three rows written, whatever the catalogue holds; fewer chunks than before
    batch(spark, log, 1, {"k7": ("new", ["only"])}, "2024-02-02")
    batch(spark, log, 2, {"k8": ("x", ["1", "2", "3"]), "fresh": ("f", ["w"])}, "2024-03-03")
    batch(spark, log, 3, {"k8": ("y", ["4"])}, "2024-04-04")
    assert rows_written(spark, place, 1) == 2
    documents = sorted([d for d in want[0] if d[0] not in ("k7", "k8")] + [("k7", "new", "ready", "2024-01-01"), ("k8", "y", "ready", "2024-01-01"), ("fresh", "f", "ready", "2024-03-03")])
    chunks = sorted([c for c in want[1] if c[0] not in ("k7", "k8")] + [("k7", 0, "only"), ("k8", 0, "4"), ("fresh", 0, "w")])
    assert seen(log) == (documents, chunks)
    before = log.catalogue.manifest()["chunks"][1]
    log.compact()
    after = log.catalogue.manifest()["chunks"][1]
    # three documents touch three buckets at most
    assert sum(before[b] != after[b] for b in before) <= 3 and seen(log) == (documents, chunks)
    # a batch that is run again after it was folded changes nothing
    batch(spark, log, 3, {"k8": ("y", ["4"])}, "2024-05-05")
    assert seen(log) == (documents, chunks)
    gone = log.expire(0)
    assert "log/chunks/batch=3" in gone and seen(DocumentLog(spark, place)) == (documents, chunks)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    log = DocumentLog(spark, str(tmp_path), buckets=2)
    for _ in range(2):
        batch(spark, log, 0, {"a": ("t", ["x", "y"])})
    assert seen(log) == ([("a", "t", "ready", "2024-01-01")], [("a", 0, "x"), ("a", 1, "y")])


def test_half_a_batch_is_not_read(spark, tmp_path):
    log = DocumentLog(spark, str(tmp_path), buckets=2)
    batch(spark, log, 0, {"a": ("t", ["x"])})
    batch(spark, log, 1, {"a": ("later", ["z"])})
    (Path(tmp_path) / "log" / "documents" / "batch=1" / "_SUCCESS").unlink()
    assert seen(log) == ([("a", "t", "ready", "2024-01-01")], [("a", 0, "x")])
    log.compact()
    assert log.folded() == 0
    batch(spark, log, 1, {"a": ("later", ["z"])})
    assert seen(log)[1] == [("a", 0, "z")]


def test_texts_of_a_batch_are_read_by_many_tasks(spark, tmp_path):
    log = DocumentLog(spark, str(tmp_path), buckets=2)
    rows = spark.range(0, 400, 1, 4).select(F.lit(1).alias("organization_id"), F.lit("local_folder").alias("source_type"), F.concat(F.lit("k"), "id").alias("source_document_key"))
    documents = rows.select("*", F.lit("t").alias("title"), F.md5("source_document_key").alias("checksum_latest"))
    log.append(0, documents, rows.select("*", F.lit(0).alias("chunk_index"), F.lit("x").alias("chunk_text")), F.expr("TIMESTAMP '2024-01-01 00:00:00'"))
    assert len(list((Path(tmp_path) / "log" / "documents" / "batch=0").glob("*.parquet"))) == 4
    assert log.documents().count() == 400
