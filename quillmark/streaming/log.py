"""Documents and chunks as committed tables and a log of what came since.

A micro-batch appends its documents and chunks to the log, so what it writes is as large as what it found, whatever
the catalogue's size.  Readers take the committed tables and put the log's newest rows of each document in their place.
`compact` folds the log into the tables: only the buckets of its documents are rewritten, and one manifest names the
new buckets and the last batch that they hold, so a reader sees each batch once, before, during and after.

A batch that is run again writes the same folder again; one that was folded already is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmark.functions.scalars import numeric_id
from quillmark.operators.changes import upsert_documents
from quillmark.sources.snapshots import BUCKETS, Catalogue

DOCUMENTS = "id long, organization_id int, source_type string, source_document_key string, title string, checksum_latest string, status string, deleted_at timestamp, created_at timestamp"
CHUNKS = "id long, organization_id int, document_id long, chunk_index int, chunk_text string"
_KEY = ["organization_id", "source_type", "source_document_key"]
_NEW_DOCUMENTS = "organization_id int, source_type string, source_document_key string, title string, checksum_latest string, created_at timestamp, batch long"
_NEW_CHUNKS = "organization_id int, source_type string, source_document_key string, chunk_index int, chunk_text string, batch long"


class DocumentLog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue = Catalogue(spark, f"{self.root}/tables")
        if not self.catalogue.numbers():
            made = lambda schema: spark.createDataFrame([], schema)
            self.catalogue.commit(
                self.catalogue.stage("documents", made(DOCUMENTS), _KEY, buckets=buckets),
                self.catalogue.stage("chunks", made(CHUNKS), ["organization_id", "document_id"], buckets=buckets),
                self._folded(-1),
            )

    def _folded(self, batch: int):
        return self.catalogue.stage("folded", self.spark.createDataFrame([(0, batch)], "id int, batch long"), ["id"], buckets=1)

    def append(self, number: int, documents: DataFrame, chunks: DataFrame, now: Column) -> None:
        """documents: the key, title, checksum_latest, a row for each; chunks: the key, chunk_index, chunk_text.

        Chunks are written first: a batch counts when its documents are whole."""
        chunks.write.mode("overwrite").parquet(f"{self.root}/log/chunks/batch={number}")
        documents.withColumn("created_at", now.cast("timestamp")).write.mode("overwrite").parquet(f"{self.root}/log/documents/batch={number}")

    def folded(self, number: int | None = None) -> int:
        return self.catalogue.read("folded", number).first()["batch"]

    def _batches(self, number: int) -> list[int]:
        """Whole batches that the snapshot doesn't hold."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/log/documents")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        found = [int(p.getName().split("=")[1]) for p in names if files.exists(hadoop.Path(p, "_SUCCESS"))]
        last = self.folded(number)
        return sorted(n for n in found if n > last)

    def _log(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/log/{kind}").parquet(*[f"{self.root}/log/{kind}/batch={n}" for n in batches])

    def _merged(self) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """(documents with `outcome`, chunks of documents in the log, the committed chunks, the last batch)."""
        number = self.catalogue.numbers()[-1]
        batches = self._batches(number)
        new = self._log("documents", _NEW_DOCUMENTS, batches)
        newest = new.groupBy(*_KEY).agg(F.max_by(F.struct("title", "checksum_latest"), "batch").alias("_new"), F.min("created_at").alias("created_at"), F.max("batch").alias("batch"))
        told = newest.select(*_KEY, "_new.title", "_new.checksum_latest", "created_at")
        after = upsert_documents(told, self.catalogue.read("documents", number), F.col("_created_at"))
        known = after.filter("outcome is not null").select(*_KEY, F.col("id").alias("document_id"))
        own = self._log("chunks", _NEW_CHUNKS, batches).join(newest.select(*_KEY, "batch"), [*_KEY, "batch"]).join(known, _KEY)
        chunks = own.select(numeric_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "organization_id", "document_id", "chunk_index", "chunk_text")
        return after, chunks, self.catalogue.read("chunks", number), max(batches, default=-1)

    def documents(self) -> DataFrame:
        return self._merged()[0].drop("outcome")

    def chunks(self) -> DataFrame:
        after, new, old, _ = self._merged()
        touched = after.filter("outcome is not null").select("organization_id", F.col("id").alias("document_id"))
        return old.join(touched, ["organization_id", "document_id"], "left_anti").unionByName(new)

    def compact(self) -> int | None:
        """Fold the log into the tables, in one commit; the number of the snapshot, or None if there is nothing to fold."""
        after, new, _, last = self._merged()
        if last < 0:
            return None
        met = after.filter("outcome is not null").drop("outcome")
        touched = met.select("organization_id", F.col("id").alias("document_id"))
        return self.catalogue.commit(self.catalogue.stage_upsert("documents", met), self.catalogue.stage_groups("chunks", new, touched), self._folded(last))

    def expire(self, keep_seconds: float) -> list[str]:
        """Drop old snapshots, and batches that even the oldest snapshot left holds."""
        gone = self.catalogue.expire(keep_seconds)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        oldest = self.folded(self.catalogue.numbers()[0])
        for kind in ("documents", "chunks"):
            path = hadoop.Path(f"{self.root}/log/{kind}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in files.listStatus(path) if files.exists(path) else []:
                if int(s.getPath().getName().split("=")[1]) <= oldest:
                    files.delete(s.getPath(), True)
                    gone.append(f"log/{kind}/{s.getPath().getName()}")
        return gone
