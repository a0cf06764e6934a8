"""Aggregates, windows, pages and operations views over catalogue tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmark.functions.predicates import check_limit
from quillmark.functions.scalars import next_run, retry_delay
from quillmark.storage import cut, few

TERMINAL = ("succeeded", "failed", "cancelled")
CEILINGS = {"entries": 100_000, "files": 10_000, "bytes": 10 * 1024**3, "chunks": 500_000}
# Failure kinds with their category, code, and whether a retry may help.
FAILURE_KINDS = (
    ("retryable_provider", "source_read", "provider_temporarily_unavailable", True),
    ("rate_limited", "rate_limit", "provider_rate_limited", True),
    ("transient_network", "source_read", "network_temporarily_unavailable", True),
    ("transient_persistence", "persistence", "transaction_temporarily_unavailable", True),
    ("authentication", "authentication", "authentication_failed", False),
    ("authorization", "authorization", "authorization_denied", False),
    ("configuration", "configuration", "configuration_invalid", False),
    ("validation", "configuration", "request_invalid", False),
    ("unsupported_content", "extraction", "content_unsupported", False),
    ("permanent_provider", "source_read", "provider_failure_permanent", False),
    ("cancelled", "internal", "execution_cancelled", False),
    ("programming_error", "internal", "programming_error", False),
    ("unknown_internal", "internal", "unknown_internal", False),
)


def run_counters(run_items: DataFrame, deletes_succeed: bool = True) -> DataFrame:
    """Counters of each run from its items.  Folder crawls don't count deletions as succeeded."""
    kinds = ("new", "changed", "unchanged", "deleted", "skipped")
    good = F.col("status") == "succeeded"
    if not deletes_succeed:
        good &= F.col("change_type") != "deleted"
    return run_items.groupBy("run_id").agg(F.count("*").alias("discovered"), *[F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in kinds], F.count_if(good).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


def next_attempt(attempts: DataFrame, key: str, number: str) -> DataFrame:
    return attempts.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_attempt"))


def run_totals(batches: DataFrame, ceilings: dict[str, int] = CEILINGS) -> DataFrame:
    """Totals of each run, and the names of the ceilings that it is over."""
    total = batches.groupBy("run_id").agg(*[F.sum(c).cast("long").alias(c) for c in ceilings])
    over = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(c)) for c, limit in ceilings.items()])), ",")
    return total.withColumn("over", over)


def ingest_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its status, its outcome if ingestion told one, and its number of chunks; those without any have 0."""
    n = chunks.groupBy("organization_id", "document_id").agg(F.count("*").alias("n_chunks"))
    told = ["outcome"] if "outcome" in documents.columns else []
    named = documents.select("organization_id", F.col("id").alias("document_id"), "status", *told)
    return named.join(n, ["organization_id", "document_id"], "left").fillna(0, ["n_chunks"])


def embedding_summary(chunks: DataFrame, model: str, embedded: DataFrame | None = None, batch: int = 128) -> DataFrame:
    """Chunks of each tenant: all, those that have a vector of the model, those that need one, the batches that takes, and
    how many of these are `embedded` (id, embedding_model) by now."""
    done = F.coalesce(F.col("embedding").isNotNull() & (F.col("embedding_model") == model), F.lit(False))
    rows = chunks.select("organization_id", "id", done.alias("_done"))
    if embedded is not None:
        rows = rows.join(embedded.filter(F.col("embedding_model") == model).select("id", F.lit(1).alias("_new")).distinct(), "id", "left")
    else:
        rows = rows.withColumn("_new", F.lit(None).cast("int"))
    counts = rows.groupBy("organization_id").agg(F.count("*").alias("total"), F.count_if("_done").alias("skipped"), F.count_if(~F.col("_done")).alias("to_embed"), F.count_if(~F.col("_done") & F.col("_new").isNotNull()).alias("embedded"))
    return counts.withColumn("batches", F.ceil(F.col("to_embed") / batch))


def page_totals(pages: DataFrame) -> DataFrame:
    text = F.btrim(F.regexp_replace("text", "\r\n?", "\n"))
    return pages.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.count_if(text != "").alias("n_text_pages"), F.sum(F.char_length(text)).cast("long").alias("n_characters"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def budget_batches(df: DataFrame, files: int = 10, total_bytes: int = 25 * 1024 * 1024, chunks: int = 500) -> DataFrame:
    """df (run_id, place, bytes, chunks, skipped) with `batch`: the longest ordered prefix within the limits, then the next.

    A cut depends on all cuts before it, so a run's rows are read in order, as a stream with a few numbers of state.  A
    file that is alone over a limit is refused, and the run ends there: it and what follows have no batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, batch, n, weight, parts, ended = None, 0, 0, 0, 0, False
        for rows in batches:
            out, refused = [], []
            for own_run, size, c, skipped in zip(*(rows.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if own_run != run:
                    run, batch, n, weight, parts, ended = own_run, 0, 0, 0, 0, False
                own = 0 if skipped else size
                alone = own > total_bytes or c > chunks
                if ended or alone:
                    out.append(None)
                    refused.append("after_refusal" if ended else "over_limit")
                    ended = True
                    continue
                if n and (n + 1 > files or weight + own > total_bytes or parts + c > chunks):
                    batch, n, weight, parts = batch + 1, 0, 0, 0
                n, weight, parts = n + 1, weight + own, parts + c
                out.append(batch)
                refused.append(None)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int32()), pa.array(refused, pa.string())], names=["run_id", "place", "batch", "refused"])

    rows = df.select(F.col("run_id").cast("long"), F.col("place").cast("long"), F.col("bytes").cast("long"), F.col("chunks").cast("long"), "skipped")
    return rows.repartition("run_id").sortWithinPartitions("run_id", "place").mapInArrow(cut, "run_id long, place long, batch int, refused string")


def first_batch(df: DataFrame, files: int = 10, total_bytes: int = 25 * 1024 * 1024, chunks: int = 500) -> DataFrame:
    """The rows of each run's first batch: running totals, no group in Python."""
    w = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    n, weight, parts = F.count("*").over(w), F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("bytes"))).over(w), F.sum("chunks").over(w)
    return df.withColumn("_in", (n <= files) & (weight <= total_bytes) & (parts <= chunks)).filter("_in").drop("_in")


def provider_batches(chunks: DataFrame, size: int = 128) -> DataFrame:
    """Chunks of each tenant in order, `size` to a batch.

    Documents are counted first and only the counts are summed along a tenant; chunks are numbered inside their document.
    """
    own = ["organization_id", "document_id"]
    counts = chunks.groupBy(*own).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("organization_id").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("chunk_index", "id"))
    return chunks.withColumn("_place", place).join(counts.select(*own, before.alias("_before")), own).withColumn("batch", F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("long")).drop("_place", "_before")


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """Each non-terminal job with the one that stands for its scope: the first by time and id."""
    w = Window.partitionBy("organization_id", "connector_scope_id").orderBy("created_at", "id")
    return jobs.filter(~F.col("status").isin(*TERMINAL)).withColumn("job_id", F.first("id").over(w)).withColumn("is_duplicate", F.col("id") != F.col("job_id"))


def current_job(jobs: DataFrame) -> DataFrame:
    return coalesce_jobs(jobs).filter(~F.col("is_duplicate")).drop("job_id", "is_duplicate")


def cursor_chain(cursors: DataFrame) -> DataFrame:
    """cursors with retired_at, when the next one took over; the last one is active."""
    after = F.lead("activated_at").over(Window.partitionBy("scope_id").orderBy("cursor_version"))
    return cursors.withColumn("retired_at", after).withColumn("status", F.when(after.isNull(), "active").otherwise("superseded"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("number", F.row_number().over(Window.partitionBy("organization_id", "document_id").orderBy("chunk_index", "id")) - 1)


def keyset_page(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, limit: int) -> DataFrame:
    """The `limit` rows after the cursor, and one more that tells that there are others: see page_of."""
    check_limit(limit, 1, 500)
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, cursor, strict=True):
            after = after | (equal & (F.col(k) > F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        df = df.filter(after)
    return df.orderBy(*keys).limit(limit + 1)


def page_of(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[list, bool, tuple | None]:
    """(rows, has_more, next cursor) of a keyset page."""
    got = rows.collect()
    more = len(got) > limit
    page = got[:limit]
    return page, more, tuple(page[-1][k] for k in keys) if more else None


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    check_limit(size, 1, 100)
    check_limit(page, 1, 1000)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def newest(df: DataFrame, order: Sequence[Column], limit: int, cap: int) -> DataFrame:
    return df.orderBy(*order).limit(max(1, min(limit, cap)))


def work_order(jobs: DataFrame) -> DataFrame:
    """jobs by priority, time due, time made and id."""
    return jobs.orderBy(F.asc("priority"), F.asc_nulls_first("next_attempt_at"), "created_at", "id")


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted df with their numbers from 1: of each partition first, then by the sizes of those before it."""
    own = cut(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(few(before.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def job_history(jobs: DataFrame, page: int, size: int, **filters) -> DataFrame:
    for column, value in filters.items():
        jobs = jobs.filter(F.col(column) == value)
    return offset_page(jobs, [F.desc("created_at"), F.desc("id")], page, size)


def runs_of_job(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of every job, at most `limit` each."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("started_at"), F.desc("id")))
    return runs.withColumn("place", place).filter(F.col("place") <= check_limit(limit, 1, 20))


def eligible_jobs(jobs: DataFrame, connectors: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that may start now, of connectors that exist."""
    due = F.col("status").isin("queued", "retry_wait") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)) & F.col("cancel_requested_at").isNull() & (F.col("attempt_count") < F.col("max_attempts"))
    return jobs.filter(due).join(connectors.select("organization_id", F.col("id").alias("connector_id")), ["organization_id", "connector_id"], "left_semi")


def expired_leases(jobs: DataFrame, as_of: Column, jitter: Column | None = None) -> DataFrame:
    """Running jobs whose lease is over, what becomes of them, and when those that try again may do so."""
    fate = F.when(F.col("cancel_requested_at").isNotNull(), "cancelled").when(F.col("attempt_count") < F.col("max_attempts"), "retry_wait").otherwise("failed")
    wait = retry_delay(F.lit("unknown_internal"), F.col("attempt_count"), F.lit(None).cast("double"), F.lit(1.0) if jitter is None else jitter)
    over = jobs.filter((F.col("status") == "running") & (F.col("lease_expires_at") <= as_of)).withColumn("fate", fate)
    at = F.timestamp_micros(F.unix_micros(as_of.cast("timestamp")) + (wait * 1_000_000).cast("long"))
    return over.withColumn("retry_at", F.when(F.col("fate") == "retry_wait", at))


def retry_decision(failures: DataFrame) -> DataFrame:
    """failures (kind, attempt_count, max_attempts, cancellation_requested, retry_after_seconds, jitter) with category, code, decision and delay."""
    kinds = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "category", "code", "retryable"), row, strict=True)]) for row in FAILURE_KINDS])).alias("k")
    known = failures.sparkSession.range(1).select(kinds).select("k.*")
    stopped = F.col("cancellation_requested") | (F.col("kind") == "cancelled")
    joined = failures.join(F.broadcast(known), "kind")
    decision = F.when(stopped, "cancelled").when(~F.col("retryable") | (F.col("attempt_count") >= F.col("max_attempts")), "failed").otherwise("retry")
    stop_code = lambda own, stop: F.when(stopped, stop).otherwise(F.col(own)).alias(own)
    out = joined.select(*[c for c in joined.columns if c not in ("category", "code")], stop_code("category", "internal"), stop_code("code", "execution_cancelled"), decision.alias("decision"))
    return out.withColumn("delay_seconds", F.when(F.col("decision") == "retry", retry_delay(F.col("kind"), F.col("attempt_count"), F.col("retry_after_seconds"), F.col("jitter"))))


SCOPE_TYPES = {"local_folder": "folder", "github": "repository"}


def _fits() -> Column:
    """Whether the scope's type is one of its connector's."""
    fits = F.lit(False)
    for kind, scope in SCOPE_TYPES.items():
        fits = fits | ((F.col("connector_type") == kind) & (F.col("scope_type") == scope))
    return F.coalesce(fits, F.lit(False))


def syncable_scopes(connectors: DataFrame, scopes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Each scope with the reason why it may not sync now; null if it may."""
    c = connectors.select("organization_id", F.col("id").alias("connector_id"), "connector_type", F.col("status").alias("_c"))
    s = spaces.select("organization_id", F.col("id").alias("knowledge_space_id"), F.col("status").alias("_s"))
    joined = scopes.join(c, ["organization_id", "connector_id"], "left").join(s, ["organization_id", "knowledge_space_id"], "left")
    live = lambda name: F.coalesce(F.col(name) == "active", F.lit(False))
    reason = F.when(~live("_c"), "connector_inactive").when(~live("status"), "scope_inactive").when(~live("_s"), "space_inactive").when(~_fits(), "type_mismatch")
    return joined.select("organization_id", F.col("id").alias("connector_scope_id"), "connector_id", reason.alias("reason"))


def due_schedules(schedules: DataFrame, connectors: DataFrame, scopes: DataFrame, as_of: Column) -> DataFrame:
    """Active schedules that are due: why they pause, or when they run next.  Scopes of a wrong type pause, too."""
    c = connectors.select("organization_id", F.col("id").alias("connector_id"), F.col("status").alias("_c"), "connector_type")
    s = scopes.select("organization_id", F.col("id").alias("connector_scope_id"), F.col("status").alias("_s"), "scope_type")
    due = schedules.filter((F.col("status") == "active") & (F.col("next_run_at") <= as_of)).join(c, ["organization_id", "connector_id"], "left").join(s, ["organization_id", "connector_scope_id"], "left")
    live = lambda name: F.coalesce(F.col(name) == "active", F.lit(False))
    reason = F.when(~live("_c"), "connector_inactive").when(~live("_s"), "scope_inactive").when(~_fits(), "type_mismatch")
    return due.withColumn("paused_reason", reason).withColumn("runs_next", F.when(F.col("paused_reason").isNull(), next_run(F.col("next_run_at"), F.col("interval_seconds"), as_of))).drop("_c", "_s", "connector_type", "scope_type")


def attempt_runs(jobs: DataFrame) -> DataFrame:
    """The run of each job's attempt: after the first its mode and trigger are `retry`."""
    again = F.col("attempt_count") > 1
    return jobs.filter("attempt_count > 0").select("id", "attempt_count", F.when(again, "retry").otherwise(F.col("mode")).alias("mode"), F.when(again, "retry").otherwise(F.col("trigger_type")).alias("trigger_type"))


def index_backlog(states: DataFrame, as_of: Column, **filters) -> DataFrame:
    """States that still need work and may have it now."""
    for column, value in filters.items():
        if value is not None:
            states = states.filter(F.col(column) == value)
    behind = F.col("indexed_generation").isNull() | (F.col("indexed_generation") < F.col("desired_generation"))
    return states.filter(behind & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))


def catalog_page(df: DataFrame, keys: Sequence[str], cursor: Sequence | None, limit: int, **filters) -> DataFrame:
    for column, value in filters.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return keyset_page(df, keys, cursor, limit)


history_page = catalog_page
