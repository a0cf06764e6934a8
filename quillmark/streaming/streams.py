"""Structured Streaming: files as they arrive, and workers that fall silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.functions.scalars import normalize_newlines
from quillmark.operators.content import chunk_documents, read_text
from quillmark.streaming.log import DocumentLog


def ingest_stream(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None], pattern: str = "*.{txt,md}") -> StreamingQuery:
    """Chunks of each file that is new below root go to `sink`, batch by batch, with the file's title and checksum; the
    checkpoint makes restarts go on."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)

    def step(batch: DataFrame, number: int) -> None:
        texts = read_text(batch).filter("rejected is null").withColumn("text", normalize_newlines(F.col("text")))
        named = texts.select("path", "title", F.sha2("text", 256).alias("checksum"))
        sink(chunk_documents(texts, key="path").join(named, "path"), number)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delta_sink(log: DocumentLog, organization_id: int, source_type: str, now: Column) -> Callable[[DataFrame, int], None]:
    """A sink for `ingest_stream` that appends what a batch found to the log, and nothing else."""

    def sink(found: DataFrame, number: int) -> None:
        of_file = [F.lit(organization_id).alias("organization_id"), F.lit(source_type).alias("source_type"), F.col("path").alias("source_document_key")]
        kept = found.persist()
        documents = kept.select(*of_file, "title", F.col("checksum").alias("checksum_latest")).distinct()
        log.append(number, documents, kept.select(*of_file, "chunk_index", F.col("content").alias("chunk_text")), now)
        kept.unpersist()

    return sink


def silent_workers(heartbeats: DataFrame, ttl_seconds: int, delay: str = "1 minute") -> DataFrame:
    """(worker, last_seen, silent_from) of every stretch in which a worker sent nothing for the time to live.

    heartbeats: worker, ts.  State is one time for each worker.  A stretch is told when the watermark has passed it,
    or when the worker's next heartbeat comes before that.  Times are told to the microsecond and compared in whole
    milliseconds, as watermarks are; they are numbers in the state, so that no session's time zone matters."""
    ttl = ttl_seconds * 1000

    def silences(worker: int, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"worker": [worker] * len(times), "last_seen": pd.Series(times, dtype="int64")})

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield silences(key[0], [last])
            return
        times = sorted(int(x) for pdf in batches for x in pdf["us"])
        if state.exists:
            times = [state.get[0], *[x for x in times if x > state.get[0]]]
        over = [a for a, b in zip(times[:-1], times[1:], strict=True) if b // 1000 - a // 1000 > ttl]
        if over:
            yield silences(key[0], over)
        state.update((times[-1],))
        state.setTimeoutTimestamp(max(times[-1] // 1000 + ttl, state.getCurrentWatermarkMs() + 1))

    marked = heartbeats.select("worker", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    told = marked.groupBy("worker").applyInPandasWithState(watch, "worker long, last_seen long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("worker", F.timestamp_micros("last_seen").alias("last_seen"), F.timestamp_micros(F.col("last_seen") + ttl * 1000).alias("silent_from"))


def silence_gaps(heartbeats: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same stretches of a finished log, in batch: gaps longer than the time to live, and the last one."""
    from pyspark.sql import Window

    w = Window.partitionBy("worker").orderBy("ts")
    after = F.lead("ts").over(w)
    gap = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return heartbeats.select("worker", "ts", gap.alias("gap")).filter((F.col("gap") > ttl_seconds * 1_000_000) | F.col("gap").isNull()).select("worker", F.col("ts").alias("last_seen"), F.col("gap").isNull().alias("is_last"))
