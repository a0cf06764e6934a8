"""The folder source in batch and as a stream."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillmark.sources import crawl, files as S


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    for key in ["a.txt", "a/b.md", "a/c/d.txt", "a-b/x.txt", "a/z.MD", "b.bin", "é.txt", "c/1.txt", "c/10.txt", "c/2.txt"]:
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text(f"text of {key}")
    (root / "empty").mkdir()
    os.symlink(root / "a.txt", root / "link.txt")
    return root


def loaded(spark, root, **options):
    crawl.register(spark)
    return spark.read.format("quillmark_files").options(**options).load(str(root))


def keys(df):
    return [r["key"] for r in df.select("key").collect()]


def test_rows_in_key_order(spark, folder):
    df = loaded(spark, folder, filesPerPartition=3)
    want = sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.is_symlink())
    assert keys(df) == want and df.rdd.getNumPartitions() == 4
    rows = {r["key"]: r for r in df.collect()}
    for key in want:
        content = (folder / key).read_bytes()
        assert (bytes(rows[key]["content"]), rows[key]["size_bytes"], rows[key]["checksum"]) == (content, len(content), hashlib.sha256(content).hexdigest())
    assert keys(loaded(spark, folder, extensions=".md, .TXT", filesPerPartition=2)) == [k for k in want if not k.endswith(".bin")]
    # the built-in scan agrees, but for the link that it follows
    other = S.scan_files(spark, str(folder), [".md", ".txt"]).filter("key <> 'link.txt'").orderBy("key")
    assert [tuple(r) for r in other.select("key", "checksum", "size_bytes").collect()] == [tuple(r) for r in loaded(spark, folder, extensions=".md,.txt").select("key", "checksum", "size_bytes").collect()]
    assert keys(loaded(spark, folder / "empty")) == []


@pytest.mark.parametrize("condition", ["key > 'a/b.md'", "key >= 'a/b.md'", "key < 'c'", "key <= 'c/1.txt'", "key = 'c/10.txt'", "key like 'a/%'", "key like '%.txt'", "key > 'a' and key < 'b' and size_bytes > 12", "key > 'zzz' and key < 'a'"])
def test_pushed_conditions(spark, folder, condition):
    whole = [r["key"] for r in spark.createDataFrame([tuple(r) for r in loaded(spark, folder).select("key", "size_bytes").collect()], "key string, size_bytes long").filter(condition).collect()]
    assert keys(loaded(spark, folder, filesPerPartition=2).filter(condition)) == whole


def test_walks_pass_by_other_folders(folder):
    seen = []
    whole = crawl.Folder(str(folder), ())
    (folder / "a" / "c").chmod(0o000)  # would fail if it were listed, but for root
    try:
        seen = [k for k, _ in whole.walk(crawl.Range("b", "c/2.txt"))]
    finally:
        (folder / "a" / "c").chmod(0o755)
    assert seen == ["b.bin", "c/1.txt", "c/10.txt", "c/2.txt"]
    assert not crawl.Range("b", "c").may_hold("a/") and crawl.Range("a/b", "c").may_hold("a/") and not crawl.Range("", "b").may_hold("c/")


def test_stream_goes_on_behind_its_offset(spark, folder, tmp_path):
    crawl.register(spark)

    def run():
        stream = spark.readStream.format("quillmark_files").option("extensions", ".txt").option("filesPerPartition", 2).load(str(folder))
        query = stream.select("key", "checksum").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        return sorted(r["key"] for r in spark.read.schema("key string, checksum string").parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == sorted(keys(loaded(spark, folder, extensions=".txt")))
    assert run() == first
    (folder / "ü.txt").write_text("new")
    (folder / "0.txt").write_text("before the offset")
    assert run() == sorted([*first, "ü.txt"])
    batch = loaded(spark, folder, extensions=".txt").filter(F.col("key") != "0.txt")
    assert run() == sorted(keys(batch))
