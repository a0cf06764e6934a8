"""Queries over changes, history, content, quality and sources, and the SQL that states the same results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from quillmark.functions import predicates as P, scalars as X
from quillmark.operators import changes as M, content as C, history as H, quality as Q, rules as R
from quillmark.plans.fixtures import AS_OF, RUN_START, Tables
from quillmark.sources import files as S
from quillmark.sources.snapshots import Catalogue
from quillmark.storage import shared_folder
from quillmark.streaming import streams as ST
from quillmark.streaming.log import DocumentLog

_JOBS_AT = "DATE '2024-01-20'"


def now():
    return F.expr(AS_OF)


def begun():
    return F.expr(RUN_START)


def jobs_at():
    return F.expr(_JOBS_AT)


def _text(*columns: str):
    """Times as text, so that no engine's time zone matters."""
    return [F.col(c).cast("string").alias(c) for c in columns]


def _state(t: Tables) -> DataFrame:
    return M.item_state(t["items"], t["versions"], t["index_states"])


def _seen(t: Tables) -> DataFrame:
    """Known memberships of every third item, some twice, and new ones in another scope."""
    columns = ["organization_id", "connector_id", "source_item_id", "connector_scope_id"]
    known = t["memberships"].filter("source_item_id % 3 = 0").select(columns)
    new = t["items"].filter("id % 5 = 1").select("organization_id", "connector_id", F.col("id").alias("source_item_id"), F.concat(F.lit("new-"), "connector_id").alias("connector_scope_id"))
    return known.unionByName(known.filter("source_item_id % 2 = 0")).unionByName(new)


def upsert_items(t: Tables) -> DataFrame:
    out = M.upsert_items(t["manifest"], t["items"], now())
    return out.select("id", *M.ITEM, "source_item_type", "source_metadata", "source_checksum", "size_bytes", "status", "restored", *_text("first_seen_at", "last_seen_at", "deleted_at"))


def upsert_memberships(t: Tables) -> DataFrame:
    return M.upsert_memberships(_seen(t), t["memberships"], now()).select("organization_id", "connector_id", "source_item_id", "connector_scope_id", "status", *_text("removed_at", "first_discovered_at", "last_seen_at"))


def retire_missing_folder(t: Tables) -> DataFrame:
    _, items, _ = M.retire_missing_folder(t["memberships"], t["items"], begun(), now())
    return items.select("organization_id", "id", "status")


def retired_memberships(t: Tables) -> DataFrame:
    held, _, _ = M.retire_missing_folder(t["memberships"], t["items"], begun(), now())
    return held.select("organization_id", "source_item_id", "connector_scope_id", "status", *_text("removed_at"))


def _candidates(t: Tables) -> DataFrame:
    return M.unseen_candidates(t["memberships"], t["items"], t["versions"], t["mappings"], t["docs"], begun())


def folder_deletions(t: Tables) -> DataFrame:
    return M.retire_missing_folder(t["memberships"], t["items"], begun(), now())[2]


def _retired(t: Tables) -> dict[str, DataFrame]:
    return M.retire_missing_repo(_candidates(t), t["memberships"], t["items"], t["versions"], t["docs"], now())


_VERSION = ["id", "organization_id", "source_item_id", "version_number", "version_cause", "lifecycle", "content_checksum", "provider_version_id", "version_metadata", "is_current"]


def repo_memberships(t: Tables) -> DataFrame:
    return _retired(t)["memberships"].select("organization_id", "source_item_id", "connector_scope_id", "status", *_text("removed_at"))


def repo_items(t: Tables) -> DataFrame:
    return _retired(t)["items"].select("id", "organization_id", "source_item_key", "status", *_text("deleted_at"))


def repo_versions(t: Tables) -> DataFrame:
    return _numbered(_retired(t)["versions"])


def repo_documents(t: Tables) -> DataFrame:
    return _retired(t)["documents"].select("id", "organization_id", "title", "status", *_text("deleted_at"))


def _numbered(versions: DataFrame) -> DataFrame:
    return versions.select(*_VERSION, *_text("discovered_at")).withColumn("version_number", F.col("version_number").cast("long"))


def _version_changes(t: Tables) -> DataFrame:
    new = t["manifest"].join(t["items"].select(*M.ITEM, "id", F.col("source_checksum").alias("_old")), M.ITEM).filter("source_checksum <> _old")
    once = new.select("organization_id", F.col("id").alias("source_item_id"), F.col("source_checksum").alias("content_checksum"), F.col("source_checksum").alias("provider_version_id"), F.lit("content_changed").alias("version_cause"), F.lit("available").alias("lifecycle"), F.lit(1).alias("change_order"))
    # some items change twice
    return once.unionByName(once.filter("source_item_id % 2 = 0").withColumn("content_checksum", F.lit("again")).withColumn("change_order", F.lit(2)))


def append_versions(t: Tables) -> DataFrame:
    return _numbered(M.append_versions(_version_changes(t), t["versions"], now()))


def _unindexable(t: Tables) -> DataFrame:
    v = t["versions"].filter("is_current and source_item_id % 2 = 0")
    blob = F.when(F.col("source_item_id") % 3 == 0, F.concat(F.lit("new-"), "provider_version_id")).otherwise(F.col("provider_version_id"))
    return v.select("organization_id", "source_item_id", blob.alias("provider_version_id"), F.lit("oversized").alias("reason"))


def _tombstones(t: Tables) -> dict[str, DataFrame]:
    return M.tombstone_unindexable(_unindexable(t), t["versions"], t["mappings"], t["docs"], t["items"], now())


def tombstone_unindexable(t: Tables) -> DataFrame:
    return _numbered(_tombstones(t)["versions"])


def unindexable_documents(t: Tables) -> DataFrame:
    return _tombstones(t)["documents"].select("id", *_text("deleted_at"))


def unindexable_items(t: Tables) -> DataFrame:
    return _tombstones(t)["items"].select("id", "status")


def unindexable_errors(t: Tables) -> DataFrame:
    return _tombstones(t)["errors"].select("organization_id", "source_item_id", "category", "code", "retryable", "attempt", *_text("occurred_at"))


def remap_materialization(t: Tables) -> DataFrame:
    new = t["versions"].filter("is_current and source_item_id % 5 = 2").select("organization_id", F.col("id").alias("document_version_id"), (F.col("source_item_id") + F.when(F.col("source_item_id") % 10 == 2, 3).otherwise(2_000_000)).alias("document_id"))
    return M.remap_materialization(new, t["all_mappings"], t["versions"])


def upsert_documents(t: Tables) -> DataFrame:
    incoming = t["manifest"].select("organization_id", F.when(F.regexp_extract("source_item_key", r"^src(\d+)/", 1).cast("int") % 2 == 0, "local_folder").otherwise("github").alias("source_type"), F.col("source_item_key").alias("source_document_key"), F.col("source_item_key").alias("title"), F.col("source_checksum").alias("checksum_latest"))
    return M.upsert_documents(incoming, t["docs"], now()).select("id", "organization_id", "source_type", "source_document_key", "title", "checksum_latest", "status", "outcome", *_text("deleted_at", "created_at"))


_CHUNK = ["organization_id", "document_id", "id", "chunk_index", "chunk_text"]


def replace_chunks(t: Tables) -> DataFrame:
    old = t["chunks"].select(_CHUNK)
    new = old.filter("document_id % 4 = 0 and chunk_index = 0").withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text"))
    return M.replace_chunks(old, new)


def advance_index_state(t: Tables) -> DataFrame:
    wanted = t["index_states"].select("id", (F.col("id") % 4).cast("long").alias("generation"))
    out = M.advance_index_state(t["index_states"], wanted)
    return out.select("id", F.col("desired_generation").cast("long").alias("desired_generation"), "status", "attempt_count", *_text("next_retry_at"))


def mark_indexed(t: Tables) -> DataFrame:
    out = M.mark_indexed(t["index_states"], t["index_states"].filter("status = 'retry_wait'"))
    return out.select("id", "status", F.col("indexed_generation").cast("long").alias("indexed_generation"))


def log_errors(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    told = t["documents"].select("doc_id", F.col("text").alias("message"), F.when(n % 4 == 2, "other").when(n % 4 == 1, "internal").otherwise("extraction").alias("category"), F.when(n % 3 == 0, "Not a code").otherwise("a_code").alias("code"))
    return M.log_errors(told).select("doc_id", "accepted")


def upsert_scopes(t: Tables) -> DataFrame:
    s = t["scopes"]
    space = (F.col("knowledge_space_id") + F.when(F.col("connector_id").like("src2%"), 1).otherwise(0)).alias("knowledge_space_id")
    incoming = s.filter("connector_id not like 'src1%' and id like '%:a'").select("organization_id", "connector_id", "external_scope_key", space, "scope_type", F.lit("hybrid").alias("access_mode"))
    more = incoming.withColumn("external_scope_key", F.concat(F.lit("more-"), "external_scope_key"))
    return M.upsert_scopes(incoming.unionByName(more), s)


_SCHEDULE = ["connector_scope_id", "status", "interval_seconds", "pause_reason_code", "last_job_id"]
_SCHEDULE_TIMES = ["next_run_at", "paused_at", "last_due_at", "last_enqueued_at"]


def upsert_schedules(t: Tables) -> DataFrame:
    wanted = t["scopes"].filter("id like '%:b'").select(F.col("id").alias("connector_scope_id"), F.lit(1800).alias("interval_seconds"), F.expr("DATE '2024-02-01'").alias("next_run_at"))
    return M.upsert_schedules(wanted, t["schedules"]).select(*_SCHEDULE, *_text(*_SCHEDULE_TIMES))


def pause_schedules(t: Tables) -> DataFrame:
    paused = t["scopes"].filter("id like 'src2%'").select(F.col("id").alias("connector_scope_id"), F.lit("scope_inactive").alias("reason_code"))
    return M.pause_schedules(t["schedules"], paused, F.expr(_JOBS_AT)).select(*_SCHEDULE, *_text(*_SCHEDULE_TIMES))


def resume_schedules(t: Tables) -> DataFrame:
    resumed = t["scopes"].filter("id like 'src1%:a'").select(F.col("id").alias("connector_scope_id"), F.expr("DATE '2024-03-01'").alias("next_run_at"))
    return M.resume_schedules(t["schedules"], resumed).select(*_SCHEDULE, *_text(*_SCHEDULE_TIMES))


def record_due(t: Tables) -> DataFrame:
    due = t["schedules"].select("connector_scope_id", F.when(F.col("connector_scope_id").like("%3%"), F.expr("DATE '2020-01-01'")).otherwise(F.col("next_run_at")).alias("due_at"), F.expr(_JOBS_AT).alias("enqueued_at"), F.lit(77).cast("long").alias("job_id"), F.expr("DATE '2024-04-01'").alias("next_run_at"))
    return M.record_due(t["schedules"], due.filter("connector_scope_id like '%:a'")).select(*_SCHEDULE, "missed", *_text(*_SCHEDULE_TIMES))


def _started(t: Tables) -> tuple[DataFrame, DataFrame]:
    asked = t["index_states"].filter("id % 3 = 0").select("id", F.lit("retry").alias("trigger_type"), F.expr(AS_OF).alias("started_at"))
    return M.start_attempts(t["index_states"], t["attempts"], asked)


def start_attempts(t: Tables) -> DataFrame:
    return _started(t)[1].select("id", "indexing_state_id", "attempt_number", "trigger_type", "status", *_text("started_at"))


def started_states(t: Tables) -> DataFrame:
    return _started(t)[0].select("id", "status", "attempt_count", *_text("next_retry_at"))


def complete_attempts(t: Tables) -> DataFrame:
    kind = F.col("indexing_state_id") % 7
    error = F.when(kind.isin(1, 2, 3), "embedding")
    results = t["attempts"].filter("indexing_state_id % 2 = 0").select("id", F.when(kind < 2, "succeeded").when(kind < 5, "failed").otherwise("cancelled").alias("status"), F.when(kind == 6, F.expr("DATE '1990-01-01'")).otherwise(F.expr("DATE '1998-05-01'")).alias("completed_at"), error.alias("error_category"), F.when(kind != 2, F.when(error.isNotNull(), "timeout")).alias("error_code"))
    return M.complete_attempts(t["attempts"], results).select("id", "status", "error_category", "error_code", "rejected", *_text("completed_at"))


def snapshot_upsert(t: Tables) -> DataFrame:
    new = t["users"].filter("id % 2 = 0").select("organization_id", "id", F.lit("reviewed").alias("status"))
    return M.upsert_snapshot(t["users"].select("organization_id", "id", "status", "normalized_email"), new, ["organization_id", "id"])


def skip_finished(t: Tables) -> DataFrame:
    plan = t["events"].select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.md5(F.when(F.col("event_id") % 4 == 0, F.lit("other")).otherwise((F.col("event_id") % 900).cast("string")).cast("binary")).alias("checksum"))
    return M.skip_finished(plan, t["run_items"]).select("run_id", "item_id", "is_stale")


def reject_stale(t: Tables) -> DataFrame:
    plan = t["manifest"].select(*M.ITEM, F.col("source_checksum").alias("expected_checksum"))
    return M.reject_stale(plan, t["items"])


def first_batch(t: Tables) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("place"), F.col("l_extendedprice").cast("long").alias("bytes"), F.col("l_quantity").cast("long").alias("chunks"), (F.col("l_returnflag") == "R").alias("skipped"), "l_suppkey", "l_tax", "l_shipdate")
    return H.first_batch(_one_place(rows), 3, 60_000, 60).select("run_id", "place")


def _one_place(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id", "place").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("chunks").cast("long").alias("chunks"), F.min("skipped").alias("skipped"))


def budget_batches(t: Tables) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("place"), F.col("l_extendedprice").cast("long").alias("bytes"), F.col("l_quantity").cast("long").alias("chunks"), (F.col("l_returnflag") == "R").alias("skipped"))
    return H.budget_batches(_one_place(rows), 3, 60_000, 60)


_PLACED = "(SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS place, sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS bytes, sum(CAST(l_quantity AS BIGINT)) AS chunks, min(l_returnflag = 'R') AS skipped FROM {lineitem} GROUP BY 1, 2)"
_JOB = ["id", "organization_id", "connector_scope_id", "status", "priority", "attempt_count"]


def due_schedules(t: Tables) -> DataFrame:
    odd = t["scopes"].withColumn("scope_type", F.when(F.col("id").like("%4:a"), "other").otherwise(F.col("scope_type")))
    out = H.due_schedules(t["schedules"], t["connectors"], odd, F.expr("DATE '2024-01-12'"))
    return out.select("connector_scope_id", "paused_reason", F.unix_seconds("runs_next").alias("runs_next_s"), F.unix_seconds(F.col("next_run_at").cast("timestamp")).alias("anchor_s")).select("connector_scope_id", "paused_reason", (F.col("runs_next_s") - F.col("anchor_s")).alias("after_anchor_s"))


def retry_decision(t: Tables) -> DataFrame:
    return H.retry_decision(t["failures"]).select("id", "kind", "category", "code", "decision", F.round("delay_seconds", 6).alias("delay_seconds"))


def paths(t: Tables) -> DataFrame:
    p = t["pages"].select("page_id", F.concat(F.substring_index("url", "://", -1), F.when(F.col("page_id") % 7 == 0, "/../x").when(F.col("page_id") % 5 == 0, "\\y").otherwise("")).alias("path"))
    return p.withColumn("valid", P.valid_path("path"))


def entries(t: Tables) -> DataFrame:
    kind = t["tree"].withColumn("entry_type", P.entry_type("mode", "object_type")).withColumn("path", F.concat("name", F.when(F.col("object_id") % 2 == 0, ".md").otherwise(".bin")))
    kind = kind.withColumn("key", F.concat("path", F.repeat(F.lit("k"), F.when(F.col("object_id") % 17 == 0, 1100).otherwise(0)))).withColumn("size_bytes", F.when(F.col("object_id") % 10 != 4, F.col("size_bytes")))
    return kind.select("object_id", "entry_type", "path", P.skip_reason("entry_type", "path", "size_bytes", key="key").alias("skip_reason"))


def scalar_names(t: Tables) -> DataFrame:
    i = t["items"]
    key = F.col("source_item_key")
    return i.select("id", X.suffix(key).alias("suffix"), X.stem(key).alias("stem"), X.mime_of(X.suffix(key)).alias("mime"), X.normalize_ext(F.concat(F.lit(" "), F.when(F.col("id") % 2 == 0, ".").otherwise(""), F.upper("source_item_type"), F.lit(" "))).alias("ext"), X.repo_item_key(F.col("organization_id"), key).alias("item_key"), X.sha256_hex(key).alias("key_sha256"), X.json_field(F.col("source_metadata"), "provider").alias("provider"), P.json_equals("source_metadata", "provider", "github").alias("is_github"), P.key_has_prefix("source_item_key", "src1").alias("has_prefix"), X.matches(F.col("connector_id"), "slug").alias("is_slug"))


def newlines(t: Tables) -> DataFrame:
    marked = t["conversation_pages"].withColumn("text", F.when(F.col("page_number") % 5 == 3, F.concat(F.lit(P.LFS_SIGNATURE + "\r\n"), "text")).otherwise(F.col("text")))
    return marked.select("document_id", "page_number", X.normalize_newlines(F.col("text")).alias("text"), P.is_lfs_pointer("text").alias("is_pointer"))


def domains(t: Tables) -> DataFrame:
    return t["users"].select("id", X.email_domain(F.col("normalized_email")).alias("domain"))


def expand_tree(t: Tables) -> DataFrame:
    return S.expand_tree(t["tree"], t["tree"].sparkSession.range(1).select(F.col("id").alias("root_tree_id"))).select("path", F.col("depth").cast("long").alias("depth"), "object_id", "object_type")


_RULES = {
    "status_known": "status in ('active', 'deleted')",
    "deleted_has_time": "(status = 'deleted') = (deleted_at is not null)",
    "seen_in_order": "first_seen_at <= last_seen_at",
    "checksum_not_blank": "trim(source_checksum) <> ''",
    "size_positive": "size_bytes > 100",
    "deleted_after_seen": "deleted_at >= last_seen_at",
}


def check_rows(t: Tables) -> DataFrame:
    return Q.check_rows(t["items"], _RULES)


#: Columns of the derived tables that row rules are held against.
_RULED = {
    "items": ["source_item_key", "source_item_type", "source_checksum", "size_bytes", "status", "deleted_at", "first_seen_at", "last_seen_at"],
    "memberships": ["status", "removed_at", "first_discovered_at", "last_seen_at"],
    "schedules": ["status", "interval_seconds", "pause_reason_code", "paused_at", "last_due_at", "last_enqueued_at"],
    "jobs": ["status", "attempt_count", "max_attempts", "next_attempt_at", "lease_expires_at", "cancel_requested_at", "created_at"],
    "versions": ["version_number", "version_cause", "lifecycle", "content_checksum", "provider_version_id"],
    "index_states": ["profile_fingerprint", "embedding_model", "embedding_dimensions", "desired_generation", "indexed_generation", "status", "reason", "attempt_count", "next_retry_at"],
    "attempts": ["attempt_number", "trigger_type", "status", "started_at", "completed_at", "error_category", "error_code"],
    "acl_entries": ["effect", "permission_level", "grants_read"],
    "departments": ["id", "status"],
    "teams": ["status"],
    "spaces": ["status"],
    **{f"{kind}_grants": ["granted_at", "expires_at", "revoked_at"] for kind in ("organization", "department", "team", "user")},
    **{f"{kind}_memberships": ["status", "effective_from", "expires_at", "revoked_at"] for kind in ("department", "team")},
    "roles": ["name"],
    "edges": ["lifecycle", "first_seen_generation", "last_seen_generation", "group_principal_id", "member_principal_id"],
    "docs": ["title", "source_type", "source_document_key", "checksum_latest", "status", "deleted_at", "created_at"],
    "chunks": ["chunk_index", "chunk_text", "embedding", "embedding_model"],
}


def check_tables(t: Tables) -> DataFrame:
    found = [R.check_table(t[name].select(columns), name) for name, columns in _RULED.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _rules_sql() -> str:
    parts = []
    for name, columns in _RULED.items():
        for rule, condition in R.rules_of(name, columns).items():
            parts.append(f"SELECT '{name}' AS \"table\", '{rule}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT coalesce({re.sub("([a-z_]+) rlike ('[^']*')", r'regexp_matches(\1, \2)', condition)}, true)) AS n_failed FROM {{{name}}}")
    return " UNION ALL ".join(x.replace("{0,", "{{0,").replace("254}", "254}}") for x in parts)


def check_vectors(t: Tables) -> DataFrame:
    odd = t["embeddings"].select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 7 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("embedding"))
    return Q.check_vectors(odd, "embedding", 64).select("vec_id", "fault")


def embedding_results(t: Tables) -> DataFrame:
    asked = t["embeddings"].select(F.col("vec_id").alias("input_index"))
    got = t["embeddings"].filter("vec_id % 9 <> 0").select(F.col("vec_id").alias("input_index"), F.when(F.col("vec_id") % 8 == 1, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 11 == 0, "m0").otherwise("m1").alias("embedding_model"))
    again = got.filter("input_index % 10 = 3")
    return Q.check_embedding_results(asked, got.unionByName(again), 64, "m1")


def _odd_json(t: Tables) -> DataFrame:
    n = F.col("event_id")
    return t["events"].select("event_id", F.when(n % 6 == 0, F.concat(F.lit('{"a": {"Token" : 1}, "b": '), "props", F.lit("}"))).when(n % 10 == 1, F.lit('{"note": "uses password=x"}')).when(n % 10 == 3, F.lit('{"where": ["x", "/etc/hosts"]}')).when(n % 10 == 5, F.lit('{"tok\\u0065n": 1}')).when(n % 10 == 7, F.lit('{"note": "no traceback (most recent call last) here, nor -----begin "}')).when(n % 10 == 9, F.lit('["C:\\\\x"]')).otherwise(F.col("props")).alias("props"))


def unsafe_json(t: Tables) -> DataFrame:
    return Q.scan_unsafe_json(_odd_json(t), "props").select("event_id", "unsafe")


def heartbeats(t: Tables) -> DataFrame:
    beats = t["events"].select(F.col("user_id").alias("worker"), "ts")
    return ST.silence_gaps(beats, 6 * 3600).groupBy("worker").agg(F.count("*").alias("n_silences"))


def backlog(t: Tables) -> DataFrame:
    half = t["chunks"].withColumn("embedding_model", F.when(F.col("id") % 7 != 0, F.col("embedding_model")))
    return C.embedding_backlog(half, "m1").select("id", "broken")


def blocks(t: Tables) -> DataFrame:
    """Tables of two rows: three cells, of which the second is blank; and a merged cell in two places before an equal one."""
    part = lambda i: F.split_part("cells", F.lit("|"), F.lit(i))
    cell = lambda row, number, text: F.struct(F.lit(row).alias("row"), F.lit(number).alias("cell"), text.alias("text"))
    full = F.array(cell(0, 0, part(1)), cell(0, 1, part(2)), cell(0, 2, part(3)), cell(1, 3, part(1)), cell(1, 3, part(1)), cell(1, 4, part(1)))
    made = t["conversation_blocks"].withColumn("cells", F.when(F.col("block_index") % 6 == 5, F.array(cell(0, 0, F.lit(" ")))).otherwise(full))
    return C.assemble_blocks(made)


def markdown_texts(t: Tables) -> DataFrame:
    bare = t["markdown"].withColumn("text", F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("# Only "), F.col("doc_id").cast("string"), F.lit("\n\n## Heads "))).when(F.col("doc_id") % 6 == 2, F.lit(" \n")).otherwise(F.col("text")))
    return C.markdown_sections(bare)


def embedding_summary(t: Tables) -> DataFrame:
    return H.embedding_summary(t["chunks"], "m1", t["chunks"].filter("id % 2 = 0").select("id", F.lit("m1").alias("embedding_model")), 16)


def ingest_summary(t: Tables) -> DataFrame:
    told = t["docs"].withColumn("outcome", F.when(F.col("id") % 3 == 0, "created").otherwise("unchanged"))
    return H.ingest_summary(told, t["chunks"])


def expired_leases(t: Tables) -> DataFrame:
    out = H.expired_leases(t["jobs"], jobs_at(), (F.col("id") % 11) / 10.0)
    return out.select("id", "fate", (F.unix_seconds("retry_at") - F.unix_seconds(jobs_at().cast("timestamp"))).alias("wait_s"))


def work_order(t: Tables) -> DataFrame:
    """The order itself, as numbers."""
    return H.numbered(H.work_order(t["jobs"].filter("status = 'queued'"))).select("id", "priority", "place")


def references(t: Tables) -> DataFrame:
    jobs = t["jobs"].select("id", "organization_id", F.when(F.col("id") % 9 == 4, F.concat("connector_id", F.lit("x"))).when(F.col("id") % 9 != 5, F.col("connector_id")).alias("connector_id"))
    return Q.check_references(jobs, t["connectors"], {"organization_id": "organization_id", "connector_id": "id"})


def chunk_faults(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    made = t["documents"].select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.when(n % 5 == 0, "  ").otherwise(F.substring("text", 1, 20)).alias("content"), F.lit(0).alias("start_offset"), F.lit(20).alias("end_offset"), F.when(n % 7 == 0, 19).otherwise(20).alias("character_count"))
    return Q.check_chunks(made.unionByName(made.filter("document_id % 11 = 0"))).select("document_id", "fault")


def fingerprints(t: Tables) -> DataFrame:
    profile = {"chunk_size": 2000, "embedding_model": "m1", "overlap": 200}
    return t["index_states"].select("id", (F.col("profile_fingerprint") == "profile-1").alias("is_one"), F.lit(X.profile_fingerprint(profile)).alias("fingerprint"))


def trimmed(t: Tables) -> DataFrame:
    odd = t["events"].select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "\u00a0 ").otherwise("\t"), "event_type", F.lit("\u2003\n")).alias("raw"))
    return odd.select("event_id", X.trim_unicode(F.col("raw")).alias("trimmed"))


def scanned_rows(t: Tables) -> DataFrame:
    """Files of the driver's folder as a catalogue table: all of a tenant's rows, by keyset."""
    P.check_limit(50, 1, 100)
    return S.scan_files_after(t["items"].select(F.col("source_item_key").alias("key"), "organization_id", "size_bytes"), "src5").filter("organization_id = 2")


def append_history(t: Tables) -> DataFrame:
    """A history of two writes, in a folder of its own."""
    place = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    for n in (1, 2):
        S.append_history(t["run_items"].select("run_id", "item_id", "status", F.lit(n).alias("n")), place)
    return t.spark.read.parquet(place)


def scanned_texts(t: Tables) -> DataFrame:
    """A text file for each source, a line for each of its documents, scanned and read."""
    place = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    lines = t["documents"].select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.md5("text")).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(place)
    files = S.scan_files(t.spark, place, [".TXT"])
    read = C.read_text(files).select("path", "text", "rejected")
    return files.join(read, "path").select(F.regexp_extract("key", "^source=([^/]+)/", 1).alias("source"), "size_bytes", "checksum", F.md5("text").alias("text_md5"), "rejected")


def silent_workers(t: Tables) -> DataFrame:
    """Of a stream of heartbeats in three batches: the silences that another heartbeat ended."""
    place, beats = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}", t["events"].select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    for n, (low, high) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"))):
        beats.filter(f"ts >= timestamp '{low}' and ts < timestamp '{high}'").coalesce(1).write.parquet(f"{place}/in/{n}")
    stream = t.spark.readStream.schema(beats.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    query = ST.silent_workers(stream, 36 * 3600).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out")
    query.awaitTermination()
    last = beats.groupBy("worker").agg(F.max("ts").alias("_last"))
    told = t.spark.read.schema("worker long, last_seen timestamp, silent_from timestamp").parquet(f"{place}/out")
    return told.join(last, "worker").filter("last_seen < _last").groupBy("worker").agg(F.count("*").alias("n_silences"), F.min(F.date_trunc("second", "last_seen").cast("string")).alias("first_seen"))


def _catalogue(t: Tables) -> Catalogue:
    return Catalogue(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}")


def classify_by_digests(t: Tables) -> DataFrame:
    """Against a committed state, of which the parts that differ are read."""
    kept = _catalogue(t)
    M.keep_state(kept, _state(t), buckets=16)
    return M.classify_by_digests(kept, t["manifest"])[0]


def committed_items(t: Tables) -> DataFrame:
    """Items after three commits: all, an upsert of some, and a removal of others."""
    kept, items = _catalogue(t), t["items"].select("id", "organization_id", "source_item_key", "status", "size_bytes")
    kept.replace("items", items, ["organization_id", "source_item_key"], buckets=8)
    kept.upsert("items", items.filter("id % 7 = 0").withColumn("status", F.lit("reviewed")))
    kept.upsert("items", items.limit(0), deleted=items.filter("id % 10 = 3"))
    return kept.read("items")


def ingested_log(t: Tables) -> DataFrame:
    """Documents and chunk counts of a log of three batches, the first two folded into the tables."""
    log = DocumentLog(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}", buckets=4)
    texts = t["documents"].select((F.col("doc_id") % 5).cast("int").alias("organization_id"), F.lit("local_folder").alias("source_type"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_document_key"), "doc_id", "text")
    for number, some in enumerate(("doc_id % 2 = 0", "doc_id % 3 = 0", "doc_id % 4 = 1")):
        found = texts.filter(some).withColumn("text", F.concat(F.lit(f"batch {number} of "), "text"))
        key = ["organization_id", "source_type", "source_document_key"]
        chunks = C.chunk_documents(found.withColumn("row", F.struct(*key)), key="row").select("row.*", "chunk_index", F.col("content").alias("chunk_text"))
        log.append(number, found.select(*key, F.lit(f"title {number}").alias("title"), F.md5("text").alias("checksum_latest")), chunks, F.expr(f"DATE '2024-01-01' + {number}"))
        if number == 1:
            log.compact()
    parts = log.chunks().groupBy("organization_id", F.col("document_id").alias("id")).agg(F.min(F.when(F.col("chunk_index") == 0, F.substring("chunk_text", 1, 10))).alias("begins"))
    return log.documents().join(parts, ["organization_id", "id"]).select("organization_id", "source_document_key", "title", "checksum_latest", "status", F.col("created_at").cast("date").cast("string").alias("created_at"), "begins")


def chunk_documents(t: Tables) -> DataFrame:
    return C.chunk_documents(t["documents"])


def embed(t: Tables) -> DataFrame:
    done = C.embed(C.embedding_backlog(t["chunks"], "m1"), C.hash_embedder(64), 64, "m1")
    own = C.set_embedding(t["chunks"], done)
    # the bytes that a vector was made of, weighed by place
    was = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.lit(64)), lambda x, i: F.round((x.cast("double") + 1) * 127.5).cast("long") * i), F.lit(0).cast("long"), lambda a, x: a + x)
    backlog = C.embedding_backlog(t["chunks"], "m1").select("id", F.lit(True).alias("fresh"))
    return own.join(backlog, "id", "left").select("id", "embedding_model", F.size("embedding").alias("dimensions"), F.when(F.col("fresh"), was).alias("weighed_bytes"))


def clear_embedding(t: Tables) -> DataFrame:
    return C.clear_embedding(t["chunks"], t["chunks"].filter("id % 3 = 0")).select("id", "embedding_model", F.col("embedding").isNull().alias("is_empty"))


_MD = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {markdown}),
heads AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(#{{1,6}}) +(\\S.*?)\\s*$') THEN length(regexp_extract(line, '^\\s*(#{{1,6}}) +', 1)) END AS level, regexp_extract(line, '^\\s*(#{{1,6}}) +(\\S.*?)\\s*$', 2) AS heading FROM lines),
parts AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM heads)"""
_ITEMS_AFTER = """SELECT coalesce(i.organization_id, m.organization_id) AS organization_id, coalesce(i.connector_id, m.connector_id) AS connector_id, coalesce(i.source_item_key, m.source_item_key) AS source_item_key, i.id IS NOT NULL AS known, m.source_item_key IS NOT NULL AS seen,
  i.* EXCLUDE (organization_id, connector_id, source_item_key), m.source_checksum AS new_sum, m.size_bytes AS new_size, m.unsupported FROM {items} i FULL JOIN {manifest} m ON m.organization_id = i.organization_id AND m.connector_id = i.connector_id AND m.source_item_key = i.source_item_key"""
_STALE = f"status = 'active' AND removed_at IS NULL AND last_seen_at < {RUN_START}"

VIEWS = {
    "w_state": """SELECT i.organization_id, i.connector_id, i.id AS source_item_id, i.source_item_key, i.source_checksum, i.status AS item_status, v.id AS document_version_id, v.content_checksum, v.version_number, v.lifecycle, s.status AS index_status, s.indexed_generation, s.desired_generation
  FROM {items} i LEFT JOIN {versions} v ON v.source_item_id = i.id AND v.organization_id = i.organization_id AND v.is_current LEFT JOIN {index_states} s ON s.document_version_id = v.id AND s.organization_id = i.organization_id""",
    "w_candidates": f"""SELECT m.organization_id, m.source_item_id, m.connector_scope_id, v.id AS document_version_id, v.version_number, d.id AS document_id FROM {{memberships}} m JOIN {{items}} i ON i.id = m.source_item_id AND i.status = 'active' JOIN {{versions}} v ON v.source_item_id = m.source_item_id AND v.is_current AND v.lifecycle = 'available'
  JOIN {{mappings}} p ON p.document_version_id = v.id JOIN {{docs}} d ON d.id = p.document_id AND d.deleted_at IS NULL WHERE m.status = 'active' AND m.removed_at IS NULL AND m.last_seen_at < {RUN_START}""",
    "w_retired": """SELECT c.*, NOT EXISTS (SELECT 1 FROM {memberships} m WHERE m.source_item_id = c.source_item_id AND m.status = 'active' AND m.removed_at IS NULL AND NOT EXISTS (SELECT 1 FROM {w_candidates} o WHERE o.source_item_id = m.source_item_id AND o.connector_scope_id = m.connector_scope_id)) AS last FROM {w_candidates} c""",
    "w_gone": "SELECT DISTINCT organization_id, source_item_id, document_id FROM {w_retired} WHERE last",
    "w_unindexable": """SELECT organization_id, source_item_id, CASE WHEN source_item_id % 3 = 0 THEN concat('new-', provider_version_id) ELSE provider_version_id END AS blob, NOT coalesce(lifecycle = 'unavailable' AND source_item_id % 3 <> 0 AND json_extract_string(version_metadata, '$.reason') = 'oversized', false) AS fresh FROM {versions} WHERE is_current AND source_item_id % 2 = 0""",
    "w_live_jobs": "SELECT *, first_value(id) OVER (PARTITION BY organization_id, connector_scope_id ORDER BY created_at, id) AS job_id FROM {jobs} WHERE status NOT IN ('succeeded', 'failed', 'cancelled')",
}

_CLASSIFIED = """SELECT organization_id, connector_id, source_item_key, change_type, CASE WHEN change_type = 'deleted' THEN 'retired' WHEN unsupported THEN 'unsupported' WHEN change_type = 'unchanged' THEN 'unchanged' ELSE 'indexed' END AS outcome FROM (
  SELECT coalesce(m.organization_id, s.organization_id) AS organization_id, coalesce(m.connector_id, s.connector_id) AS connector_id, coalesce(m.source_item_key, s.source_item_key) AS source_item_key, m.unsupported,
    CASE WHEN m.source_item_key IS NULL THEN 'deleted' WHEN s.source_item_key IS NULL THEN 'new' WHEN m.unsupported THEN 'changed' WHEN s.source_checksum = m.source_checksum AND s.content_checksum = m.source_checksum AND s.index_status = 'indexed' AND s.indexed_generation = s.desired_generation AND s.item_status = 'active' THEN 'unchanged' ELSE 'changed' END AS change_type
  FROM {manifest} m FULL JOIN {w_state} s ON s.organization_id = m.organization_id AND s.connector_id = m.connector_id AND s.source_item_key = m.source_item_key)"""

QUERIES = {
    # changes
    "diff_catalog": (lambda t: M.diff_catalog(t["manifest"], t["items"]), f"SELECT organization_id, connector_id, source_item_key, seen, known FROM ({_ITEMS_AFTER})"),
    "item_state": (_state, "SELECT * FROM {w_state}"),
    "classify_changes": (
        lambda t: M.classify_changes(t["manifest"], _state(t)),
        _CLASSIFIED,
    ),
    "classify_by_digests": (
        classify_by_digests,
        _CLASSIFIED,
    ),
    "committed_items": (
        committed_items,
        "SELECT id, organization_id, source_item_key, CASE WHEN id % 7 = 0 THEN 'reviewed' ELSE status END AS status, size_bytes FROM {items} WHERE id % 10 <> 3",
    ),
    "ingested_log": (
        ingested_log,
        """SELECT CAST(doc_id % 5 AS INT) AS organization_id, concat(source, '/', CAST(doc_id AS VARCHAR)) AS source_document_key, concat('title ', CAST(newest AS VARCHAR)) AS title, md5(concat('batch ', CAST(newest AS VARCHAR), ' of ', text)) AS checksum_latest, 'ready' AS status,
  CAST(DATE '2024-01-01' + first AS VARCHAR) AS created_at, concat('batch ', CAST(newest AS VARCHAR), ' of') AS begins FROM (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS newest, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS first
  FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 1)""",
    ),
    "classify_run": (
        lambda t: M.classify_changes(t["manifest"], M.item_state(t["items"], t["versions"], t["index_states"], None, t["folder_run"])),
        """SELECT organization_id, connector_id, source_item_key, change_type, CASE WHEN change_type = 'deleted' THEN 'retired' WHEN unsupported THEN 'unsupported' WHEN done THEN 'already_complete' WHEN change_type = 'unchanged' THEN 'unchanged' ELSE 'indexed' END AS outcome FROM (
  SELECT coalesce(m.organization_id, s.organization_id) AS organization_id, coalesce(m.connector_id, s.connector_id) AS connector_id, coalesce(m.source_item_key, s.source_item_key) AS source_item_key, m.unsupported, EXISTS (SELECT 1 FROM {folder_run} r WHERE r.source_item_id = s.source_item_id AND r.status <> 'failed' AND r.current_checksum = m.source_checksum) AS done,
    CASE WHEN m.source_item_key IS NULL THEN 'deleted' WHEN s.source_item_key IS NULL THEN 'new' WHEN m.unsupported THEN 'changed' WHEN s.source_checksum = m.source_checksum AND s.content_checksum = m.source_checksum AND s.index_status = 'indexed' AND s.indexed_generation = s.desired_generation AND s.item_status = 'active' THEN 'unchanged' ELSE 'changed' END AS change_type
  FROM {manifest} m FULL JOIN {w_state} s ON s.organization_id = m.organization_id AND s.connector_id = m.connector_id AND s.source_item_key = m.source_item_key)""",
    ),
    "upsert_items": (upsert_items, f"""SELECT coalesce(id, CAST('0x' || substr(sha256(concat_ws('|', organization_id, connector_id, source_item_key)), 1, 15) AS BIGINT)) AS id, organization_id, connector_id, source_item_key, source_item_type, source_metadata, CASE WHEN seen THEN new_sum ELSE source_checksum END AS source_checksum, CASE WHEN seen THEN new_size ELSE size_bytes END AS size_bytes, CASE WHEN seen THEN 'active' ELSE status END AS status, coalesce(seen AND known AND status <> 'active', false) AS restored,
  CAST(coalesce(first_seen_at, {AS_OF}) AS VARCHAR) AS first_seen_at, CAST(CASE WHEN seen THEN {AS_OF} ELSE last_seen_at END AS VARCHAR) AS last_seen_at, CAST(CASE WHEN NOT seen THEN deleted_at END AS VARCHAR) AS deleted_at FROM ({_ITEMS_AFTER})"""),
    "upsert_memberships": (
        upsert_memberships,
        f"""SELECT organization_id, connector_id, source_item_id, connector_scope_id, CASE WHEN source_item_id % 3 = 0 THEN 'active' ELSE status END AS status, CAST(CASE WHEN source_item_id % 3 <> 0 THEN removed_at END AS VARCHAR) AS removed_at, CAST(first_discovered_at AS VARCHAR) AS first_discovered_at,
  CAST(CASE WHEN source_item_id % 3 = 0 THEN {AS_OF} ELSE last_seen_at END AS VARCHAR) AS last_seen_at FROM {{memberships}}
  UNION ALL SELECT organization_id, connector_id, id, concat('new-', connector_id), 'active', NULL, CAST({AS_OF} AS VARCHAR), CAST({AS_OF} AS VARCHAR) FROM {{items}} WHERE id % 5 = 1""",
    ),
    "items_in_scope": (lambda t: M.items_in_scope(t["items"], t["memberships"].filter("connector_scope_id like '%:b'")).select("organization_id", "id"), "SELECT organization_id, id FROM {items} i WHERE EXISTS (SELECT 1 FROM {memberships} m WHERE m.source_item_id = i.id AND m.organization_id = i.organization_id AND m.connector_scope_id LIKE '%:b')"),
    "without_active_membership": (lambda t: M.without_active_membership(t["items"], t["memberships"]).select("organization_id", "id"), "SELECT organization_id, id FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM {memberships} m WHERE m.source_item_id = i.id AND m.status = 'active' AND m.removed_at IS NULL)"),
    "retired_memberships": (retired_memberships, f"SELECT organization_id, source_item_id, connector_scope_id, CASE WHEN {_STALE} THEN 'removed' ELSE status END AS status, CAST(CASE WHEN {_STALE} THEN {AS_OF} ELSE removed_at END AS VARCHAR) AS removed_at FROM {{memberships}}"),
    "retire_missing_folder": (
        retire_missing_folder,
        f"SELECT organization_id, id, CASE WHEN EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.source_item_id = i.id AND {_STALE.replace('status', 'm.status')}) AND NOT EXISTS (SELECT 1 FROM {{memberships}} m WHERE m.source_item_id = i.id AND m.status = 'active' AND m.removed_at IS NULL AND m.last_seen_at >= {RUN_START}) THEN 'unavailable' ELSE status END AS status FROM {{items}} i".replace("removed_at IS NULL AND last_seen_at", "m.removed_at IS NULL AND m.last_seen_at"),
    ),
    "folder_deletions": (
        folder_deletions,
        f"""SELECT organization_id, source_item_id, connector_scope_id, 'deleted' AS change_type, 'succeeded' AS status FROM {{memberships}} WHERE {_STALE}""",
    ),
    "unseen_candidates": (lambda t: _candidates(t).select("organization_id", "source_item_id", "connector_scope_id", "document_version_id", "version_number", "document_id"), "SELECT * FROM {w_candidates}"),
    "retire_missing_repo": (
        lambda t: M.repo_retirements(_candidates(t), t["memberships"]),
        """SELECT organization_id, source_item_id, connector_scope_id, document_id, last AS deletes_item, CASE WHEN last THEN version_number + 1 END AS tombstone_version FROM {w_retired}""",
    ),
    "repo_deletions": (
        lambda t: _retired(t)["run_items"],
        """SELECT c.organization_id, c.source_item_id, c.connector_scope_id, 'deleted' AS change_type, 'succeeded' AS status, i.source_checksum AS previous_checksum FROM {w_candidates} c JOIN {items} i ON i.id = c.source_item_id""",
    ),
    "repo_memberships": (
        repo_memberships,
        f"""SELECT organization_id, source_item_id, connector_scope_id, CASE WHEN c THEN 'removed' ELSE status END AS status, CAST(CASE WHEN c THEN {AS_OF} ELSE removed_at END AS VARCHAR) AS removed_at FROM (SELECT *, EXISTS (SELECT 1 FROM {{w_candidates}} c WHERE c.source_item_id = m.source_item_id AND c.connector_scope_id = m.connector_scope_id) AS c FROM {{memberships}} m)""",
    ),
    "repo_documents": (
        repo_documents,
        f"""SELECT id, organization_id, title, status, CAST(CASE WHEN id IN (SELECT document_id FROM {{w_gone}}) THEN coalesce(deleted_at, {AS_OF}) ELSE deleted_at END AS VARCHAR) AS deleted_at FROM {{docs}}""",
    ),
    "repo_items": (
        repo_items,
        f"""SELECT id, organization_id, source_item_key, CASE WHEN g THEN 'deleted' ELSE status END AS status, CAST(CASE WHEN g THEN {AS_OF} ELSE deleted_at END AS VARCHAR) AS deleted_at FROM (SELECT *, id IN (SELECT source_item_id FROM {{w_gone}}) AS g FROM {{items}})""",
    ),
    "repo_versions": (
        repo_versions,
        f"""SELECT *, row_number() OVER (PARTITION BY organization_id, source_item_id ORDER BY version_number DESC) = 1 AS is_current FROM (SELECT id, organization_id, source_item_id, CAST(version_number AS BIGINT) AS version_number, version_cause, lifecycle, content_checksum, provider_version_id, version_metadata, CAST(discovered_at AS VARCHAR) AS discovered_at FROM {{versions}}
  UNION ALL SELECT CAST('0x' || substr(sha256(concat_ws('|', n.source_item_id, n.k)), 1, 15) AS BIGINT), organization_id, n.source_item_id, n.k, 'tombstone', 'deleted', NULL, v.provider_version_id, '{{{{"reason":"provider_deleted"}}}}', CAST({AS_OF} AS VARCHAR) FROM (SELECT g.*, (SELECT max(version_number) + 1 FROM {{versions}} v WHERE v.source_item_id = g.source_item_id) AS k FROM (SELECT DISTINCT organization_id, source_item_id FROM {{w_gone}}) g) n
  JOIN (SELECT source_item_id, provider_version_id FROM {{versions}} WHERE is_current) v USING (source_item_id))""",
    ),
    "append_versions": (
        append_versions,
        f"""SELECT *, row_number() OVER (PARTITION BY organization_id, source_item_id ORDER BY version_number DESC) = 1 AS is_current FROM (SELECT id, organization_id, source_item_id, CAST(version_number AS BIGINT) AS version_number, version_cause, lifecycle, content_checksum, provider_version_id, version_metadata, CAST(discovered_at AS VARCHAR) AS discovered_at FROM {{versions}}
  UNION ALL SELECT CAST('0x' || substr(sha256(concat_ws('|', sid, k)), 1, 15) AS BIGINT), organization_id, sid, k, 'content_changed', 'available', CASE WHEN n.n = 1 THEN new_sum ELSE 'again' END, new_sum, NULL, CAST({AS_OF} AS VARCHAR) FROM (SELECT c.*, n.n, (SELECT max(version_number) FROM {{versions}} v WHERE v.source_item_id = c.sid) + n.n AS k
    FROM (SELECT i.organization_id, i.id AS sid, m.source_checksum AS new_sum FROM {{items}} i JOIN {{manifest}} m USING (organization_id, connector_id, source_item_key) WHERE m.source_checksum <> i.source_checksum) c JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) n ON n.n = 1 OR c.sid % 2 = 0) n)""",
    ),
    "next_version": (lambda t: M.next_version(t["versions"]), "SELECT organization_id, source_item_id, max(version_number) + 1 AS next_version FROM {versions} GROUP BY 1, 2"),
    "tombstone_unindexable": (
        tombstone_unindexable,
        f"""SELECT *, row_number() OVER (PARTITION BY organization_id, source_item_id ORDER BY version_number DESC) = 1 AS is_current FROM (SELECT id, organization_id, source_item_id, CAST(version_number AS BIGINT) AS version_number, version_cause, lifecycle, content_checksum, provider_version_id, version_metadata, CAST(discovered_at AS VARCHAR) AS discovered_at FROM {{versions}}
  UNION ALL SELECT CAST('0x' || substr(sha256(concat_ws('|', source_item_id, k)), 1, 15) AS BIGINT), organization_id, source_item_id, k, 'tombstone', 'unavailable', NULL, blob, '{{{{"reason":"oversized"}}}}', CAST({AS_OF} AS VARCHAR) FROM (SELECT u.*, (SELECT max(version_number) + 1 FROM {{versions}} v WHERE v.source_item_id = u.source_item_id) AS k FROM {{w_unindexable}} u WHERE fresh))""",
    ),
    "unindexable_errors": (
        unindexable_errors,
        f"""SELECT organization_id, source_item_id, 'extraction' AS category, 'oversized' AS code, false AS retryable, 1 AS attempt, CAST({AS_OF} AS VARCHAR) AS occurred_at FROM {{w_unindexable}}""",
    ),
    "unindexable_items": (
        unindexable_items,
        """SELECT id, CASE WHEN id % 2 = 0 THEN 'unavailable' ELSE status END AS status FROM {items}""",
    ),
    "unindexable_documents": (
        unindexable_documents,
        f"""SELECT id, CAST(CASE WHEN id IN (SELECT m.document_id FROM {{mappings}} m JOIN {{versions}} v ON v.id = m.document_version_id WHERE v.is_current AND v.source_item_id % 2 = 0) THEN coalesce(deleted_at, {AS_OF}) ELSE deleted_at END AS VARCHAR) AS deleted_at FROM {{docs}}""",
    ),
    "remap_materialization": (
        remap_materialization,
        """WITH fresh AS (SELECT organization_id, id AS document_version_id, source_item_id + CASE WHEN source_item_id % 10 = 2 THEN 3 ELSE 2000000 END AS document_id, source_item_id FROM {versions} WHERE is_current AND source_item_id % 5 = 2)
SELECT organization_id, document_version_id, document_id FROM fresh UNION ALL SELECT m.organization_id, m.document_version_id, m.document_id FROM {all_mappings} m JOIN {versions} v ON v.id = m.document_version_id
WHERE m.document_version_id NOT IN (SELECT document_version_id FROM fresh) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.organization_id = m.organization_id AND f.document_id = m.document_id) AND v.source_item_id NOT IN (SELECT source_item_id FROM fresh)""",
    ),
    "current_materialization": (lambda t: M.current_materialization(t["versions"], t["mappings"]), "SELECT v.organization_id, v.source_item_id, v.id AS document_version_id, m.document_id FROM {versions} v JOIN {mappings} m ON m.document_version_id = v.id WHERE v.is_current"),
    "upsert_documents": (
        upsert_documents,
        f"""SELECT coalesce(id, CAST('0x' || substr(sha256(concat_ws('|', organization_id, source_type, source_document_key)), 1, 15) AS BIGINT)) AS id, organization_id, source_type, source_document_key, coalesce(nt, title) AS title, coalesce(ns, checksum_latest) AS checksum_latest, CASE WHEN seen THEN 'ready' ELSE status END AS status, CASE WHEN NOT seen THEN NULL WHEN NOT known THEN 'created' WHEN deleted_at IS NOT NULL THEN 'restored' WHEN checksum_latest = ns THEN 'unchanged' ELSE 'updated' END AS outcome,
  CAST(CASE WHEN NOT seen THEN deleted_at END AS VARCHAR) AS deleted_at, CAST(coalesce(created_at, {AS_OF}) AS VARCHAR) AS created_at FROM (SELECT coalesce(d.organization_id, m.organization_id) AS organization_id, coalesce(d.source_type, m.source_type) AS source_type, coalesce(d.source_document_key, m.k) AS source_document_key, d.title, d.checksum_latest, d.status, d.deleted_at, d.created_at, d.id, d.id IS NOT NULL AS known, m.k IS NOT NULL AS seen, m.k AS nt, m.ns
  FROM {{docs}} d FULL JOIN (SELECT organization_id, source_item_key AS k, source_checksum AS ns, CASE WHEN CAST(regexp_extract(source_item_key, '^src(\\d+)/', 1) AS INT) % 2 = 0 THEN 'local_folder' ELSE 'github' END AS source_type FROM {{manifest}}) m ON m.organization_id = d.organization_id AND m.source_type = d.source_type AND m.k = d.source_document_key)""",
    ),
    "replace_chunks": (replace_chunks, "SELECT organization_id, document_id, id, chunk_index, CASE WHEN document_id % 4 = 0 THEN concat('new ', chunk_text) ELSE chunk_text END AS chunk_text FROM {chunks} WHERE document_id % 4 <> 0 OR chunk_index = 0"),
    "ensure_index_state": (
        lambda t: M.ensure_index_state(t["versions"], t["index_states"], "profile-1", "m2", 128, "profile_changed").withColumn("next_retry_at", F.col("next_retry_at").cast("string")),
        """SELECT * REPLACE (CAST(next_retry_at AS VARCHAR) AS next_retry_at) FROM {index_states} UNION ALL SELECT CAST('0x' || substr(sha256(concat_ws('|', id, 'profile-1')), 1, 15) AS BIGINT), organization_id, id, 'profile-1', 'm2', 128, 1, 0, 'pending', 'profile_changed', 0, NULL
  FROM {versions} v WHERE is_current AND NOT EXISTS (SELECT 1 FROM {index_states} s WHERE s.document_version_id = v.id AND s.profile_fingerprint = 'profile-1')""",
    ),
    "advance_index_state": (advance_index_state, "SELECT id, CAST(greatest(desired_generation, id % 4) AS BIGINT) AS desired_generation, CASE WHEN id % 4 > desired_generation THEN 'pending' ELSE status END AS status, CASE WHEN id % 4 > desired_generation THEN 0 ELSE attempt_count END AS attempt_count, CAST(CASE WHEN id % 4 <= desired_generation THEN next_retry_at END AS VARCHAR) AS next_retry_at FROM {index_states}"),
    "complete_attempts": (
        complete_attempts,
        """SELECT id, CASE WHEN taken THEN ns ELSE status END AS status, CASE WHEN taken THEN ec ELSE error_category END AS error_category, CASE WHEN taken THEN CASE WHEN k <> 2 AND ec IS NOT NULL THEN 'timeout' END ELSE error_code END AS error_code, reason AS rejected, CAST(CASE WHEN taken THEN DATE '1998-05-01' ELSE completed_at END AS VARCHAR) AS completed_at
  FROM (SELECT *, met AND reason IS NULL AS taken FROM (SELECT *, CASE WHEN NOT met THEN NULL WHEN status <> 'running' THEN 'not_running' WHEN k = 6 THEN 'before_start' WHEN k = 2 THEN 'half_an_error' WHEN ns = 'succeeded' AND ec IS NOT NULL THEN 'error_of_success' WHEN ns = 'failed' AND ec IS NULL THEN 'failure_without_error' END AS reason
    FROM (SELECT *, indexing_state_id % 2 = 0 AS met, indexing_state_id % 7 AS k, CASE WHEN indexing_state_id % 7 < 2 THEN 'succeeded' WHEN indexing_state_id % 7 < 5 THEN 'failed' ELSE 'cancelled' END AS ns, CASE WHEN indexing_state_id % 7 IN (1, 2, 3) THEN 'embedding' END AS ec FROM {attempts})))""",
    ),
    "started_states": (
        started_states,
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'processing' ELSE status END AS status, CAST(attempt_count + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS attempt_count, CAST(CASE WHEN id % 3 <> 0 THEN next_retry_at END AS VARCHAR) AS next_retry_at FROM {index_states}""",
    ),
    "start_attempts": (
        start_attempts,
        f"""SELECT id, indexing_state_id, attempt_number, trigger_type, status, CAST(started_at AS VARCHAR) AS started_at FROM {{attempts}}
  UNION ALL SELECT CAST('0x' || substr(sha256(concat_ws('|', id, k)), 1, 15) AS BIGINT), id, CAST(k AS INT), 'retry', 'running', CAST({AS_OF} AS VARCHAR) FROM (SELECT s.id, coalesce((SELECT max(attempt_number) FROM {{attempts}} a WHERE a.indexing_state_id = s.id), 0) + 1 AS k FROM {{index_states}} s WHERE s.id % 3 = 0)""",
    ),
    "mark_indexed": (mark_indexed, "SELECT id, CASE WHEN status = 'retry_wait' THEN 'indexed' ELSE status END AS status, CAST(CASE WHEN status = 'retry_wait' THEN desired_generation ELSE indexed_generation END AS BIGINT) AS indexed_generation FROM {index_states}"),
    "log_errors": (
        log_errors,
        """SELECT doc_id, length(text) <= 1000 AND length(text) - length(replace(text, chr(10), '')) <= 3 AND NOT contains(text, 'Traceback (most recent call last)') AND trim(text) <> '' AND doc_id % 4 <> 2 AND doc_id % 3 <> 0 AS accepted FROM {documents}""",
    ),
    "upsert_scopes": (
        upsert_scopes,
        """SELECT coalesce(id, sha256(concat_ws('|', concat(strlen(CAST(organization_id AS VARCHAR)), ':', organization_id), concat(strlen(connector_id), ':', connector_id), concat(strlen(external_scope_key), ':', external_scope_key)))) AS id, organization_id, connector_id, external_scope_key,
  coalesce(os, ns) AS knowledge_space_id, coalesce(ot, nt) AS scope_type, CASE WHEN outcome IN ('created', 'restored', 'kept') THEN 'hybrid' ELSE mode END AS access_mode, CASE WHEN outcome IN ('created', 'restored', 'kept') THEN 'active' WHEN outcome = 'removed' THEN 'removed' ELSE status END AS status, outcome
  FROM (SELECT *, CASE WHEN os IS NULL THEN 'created' WHEN ns IS NULL AND connector_id LIKE 'src1%' THEN 'untouched' WHEN ns IS NULL THEN CASE WHEN status = 'active' THEN 'removed' ELSE 'untouched' END WHEN ns <> os THEN 'conflict' WHEN status <> 'active' THEN 'restored' ELSE 'kept' END AS outcome
  FROM (SELECT organization_id, connector_id, external_scope_key, max(id) AS id, max(os) AS os, max(ns) AS ns, max(ot) AS ot, max(nt) AS nt, max(mode) AS mode, max(status) AS status FROM (SELECT organization_id, connector_id, external_scope_key, id, knowledge_space_id AS os, NULL AS ns, scope_type AS ot, NULL AS nt, access_mode AS mode, status FROM {scopes}
    UNION ALL SELECT organization_id, connector_id, concat(p.p, external_scope_key), NULL, NULL, knowledge_space_id + CASE WHEN connector_id LIKE 'src2%' THEN 1 ELSE 0 END, NULL, scope_type, NULL, NULL FROM {scopes} CROSS JOIN (SELECT '' AS p UNION ALL SELECT 'more-') p WHERE connector_id NOT LIKE 'src1%' AND id LIKE '%:a') GROUP BY 1, 2, 3))""",
    ),
    "set_status": (
        lambda t: M.set_status(t["items"], "deleted", now()).select("id", "status", *_text("deleted_at")),
        f"SELECT id, 'deleted' AS status, CAST(coalesce(deleted_at, {AS_OF}) AS VARCHAR) AS deleted_at FROM {{items}}",
    ),
    "upsert_schedules": (
        upsert_schedules,
        """SELECT connector_scope_id, CASE WHEN connector_scope_id LIKE '%:b' THEN 'active' ELSE status END AS status, CASE WHEN connector_scope_id LIKE '%:b' THEN 1800 ELSE interval_seconds END AS interval_seconds, CASE WHEN connector_scope_id LIKE '%:b' THEN NULL ELSE pause_reason_code END AS pause_reason_code, CASE WHEN connector_scope_id LIKE '%:b' THEN NULL ELSE last_job_id END AS last_job_id, CAST(CASE WHEN connector_scope_id LIKE '%:b' THEN DATE '2024-02-01' ELSE next_run_at END AS VARCHAR) AS next_run_at, CAST(CASE WHEN connector_scope_id LIKE '%:b' THEN NULL ELSE paused_at END AS VARCHAR) AS paused_at, CAST(CASE WHEN connector_scope_id LIKE '%:b' THEN NULL ELSE last_due_at END AS VARCHAR) AS last_due_at, CAST(CASE WHEN connector_scope_id LIKE '%:b' THEN NULL ELSE last_enqueued_at END AS VARCHAR) AS last_enqueued_at FROM {schedules}""",
    ),
    "record_due": (
        record_due,
        """SELECT connector_scope_id, status AS status, interval_seconds AS interval_seconds, pause_reason_code AS pause_reason_code, CASE WHEN connector_scope_id LIKE '%:a' AND status = 'active' AND connector_scope_id NOT LIKE '%3%' THEN 77 ELSE last_job_id END AS last_job_id, CAST(CASE WHEN connector_scope_id LIKE '%:a' AND status = 'active' AND connector_scope_id NOT LIKE '%3%' THEN DATE '2024-04-01' ELSE next_run_at END AS VARCHAR) AS next_run_at, CAST(paused_at AS VARCHAR) AS paused_at, CAST(CASE WHEN connector_scope_id LIKE '%:a' AND status = 'active' AND connector_scope_id NOT LIKE '%3%' THEN next_run_at ELSE last_due_at END AS VARCHAR) AS last_due_at, CAST(CASE WHEN connector_scope_id LIKE '%:a' AND status = 'active' AND connector_scope_id NOT LIKE '%3%' THEN DATE '2024-01-20' ELSE last_enqueued_at END AS VARCHAR) AS last_enqueued_at, connector_scope_id LIKE '%:a' AND NOT (connector_scope_id LIKE '%:a' AND status = 'active' AND connector_scope_id NOT LIKE '%3%') AS missed FROM {schedules}""",
    ),
    "resume_schedules": (
        resume_schedules,
        """SELECT connector_scope_id, CASE WHEN connector_scope_id LIKE 'src1%:a' THEN 'active' ELSE status END AS status, interval_seconds AS interval_seconds, CASE WHEN connector_scope_id LIKE 'src1%:a' THEN NULL ELSE pause_reason_code END AS pause_reason_code, last_job_id AS last_job_id, CAST(CASE WHEN connector_scope_id LIKE 'src1%:a' THEN DATE '2024-03-01' ELSE next_run_at END AS VARCHAR) AS next_run_at, CAST(CASE WHEN connector_scope_id LIKE 'src1%:a' THEN NULL ELSE paused_at END AS VARCHAR) AS paused_at, CAST(last_due_at AS VARCHAR) AS last_due_at, CAST(last_enqueued_at AS VARCHAR) AS last_enqueued_at FROM {schedules}""",
    ),
    "pause_schedules": (
        pause_schedules,
        """SELECT connector_scope_id, CASE WHEN connector_scope_id LIKE 'src2%' THEN 'paused' ELSE status END AS status, interval_seconds AS interval_seconds, CASE WHEN connector_scope_id LIKE 'src2%' THEN 'scope_inactive' ELSE pause_reason_code END AS pause_reason_code, last_job_id AS last_job_id, CAST(next_run_at AS VARCHAR) AS next_run_at, CAST(CASE WHEN connector_scope_id LIKE 'src2%' THEN DATE '2024-01-20' ELSE paused_at END AS VARCHAR) AS paused_at, CAST(last_due_at AS VARCHAR) AS last_due_at, CAST(last_enqueued_at AS VARCHAR) AS last_enqueued_at FROM {schedules}""",
    ),
    "purge_expired": (lambda t: M.purge_expired(t["user_grants"], "expires_at", now()).select("organization_id", "user_id", "knowledge_space_id"), f"SELECT organization_id, user_id, knowledge_space_id FROM {{user_grants}} WHERE expires_at IS NULL OR expires_at > {AS_OF}"),
    "expire_stale": (lambda t: M.expire_stale(t["jobs"], "lease_expires_at", jobs_at(), 20).select("id"), f"SELECT id FROM {{jobs}} WHERE id NOT IN (SELECT id FROM {{jobs}} WHERE lease_expires_at <= {_JOBS_AT} ORDER BY lease_expires_at, id LIMIT 20)"),
    "skip_finished": (
        skip_finished,
        """SELECT run_id, item_id, coalesce(done, false) AND current_checksum <> checksum AS is_stale FROM (SELECT e.user_id AS run_id, e.event_id AS item_id, md5(CASE WHEN e.event_id % 4 = 0 THEN 'other' ELSE CAST(e.event_id % 900 AS VARCHAR) END) AS checksum, r.status = 'succeeded' AS done, r.current_checksum FROM {events} e JOIN {run_items} r ON r.run_id = e.user_id AND r.item_id = e.event_id) WHERE NOT done OR current_checksum <> checksum""",
    ),
    "reject_stale": (reject_stale, "SELECT m.organization_id, m.connector_id, m.source_item_key, m.source_checksum AS expected_checksum, i.id IS NULL OR i.source_checksum <> m.source_checksum AS is_stale FROM {manifest} m LEFT JOIN {items} i USING (organization_id, connector_id, source_item_key)"),
    "upsert_snapshot": (snapshot_upsert, "SELECT organization_id, id, CASE WHEN id % 2 = 0 THEN 'reviewed' ELSE status END AS status, normalized_email FROM {users}"),
    # aggregates and windows
    "run_counters": (
        lambda t: H.run_counters(t["run_items"]),
        "SELECT run_id, count(*) AS discovered, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'changed') AS n_changed, count(*) FILTER (change_type = 'unchanged') AS n_unchanged, count(*) FILTER (change_type = 'deleted') AS n_deleted, count(*) FILTER (change_type = 'skipped') AS n_skipped, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM {run_items} GROUP BY 1",
    ),
    "next_attempt": (lambda t: H.next_attempt(t["jobs"], "connector_scope_id", "attempt_count"), "SELECT connector_scope_id, max(attempt_count) + 1 AS next_attempt FROM {jobs} GROUP BY 1"),
    "run_totals": (lambda t: H.run_totals(t["batches"], {"entries": 200, "files": 30, "bytes": 400_000, "chunks": 500}), "SELECT *, concat_ws(',', CASE WHEN entries > 200 THEN 'entries' END, CASE WHEN files > 30 THEN 'files' END, CASE WHEN bytes > 400000 THEN 'bytes' END, CASE WHEN chunks > 500 THEN 'chunks' END) AS over FROM (SELECT l_orderkey AS run_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS entries, CAST(sum(CAST(trunc(l_quantity / 5) AS BIGINT)) AS BIGINT) AS files, CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes, CAST(sum(CAST(l_quantity AS BIGINT) * 3) AS BIGINT) AS chunks FROM {lineitem} GROUP BY 1)"),
    "ingest_summary": (
        ingest_summary,
        """SELECT d.organization_id, d.id AS document_id, d.status, CASE WHEN d.id % 3 = 0 THEN 'created' ELSE 'unchanged' END AS outcome, count(c.id) AS n_chunks FROM {docs} d LEFT JOIN {chunks} c ON c.document_id = d.id AND c.organization_id = d.organization_id GROUP BY ALL""",
    ),
    "embedding_summary": (
        embedding_summary,
        """SELECT *, CAST(ceil(to_embed / 16) AS BIGINT) AS batches FROM (SELECT organization_id, count(*) AS total, count(*) FILTER (embedding IS NOT NULL AND embedding_model = 'm1') AS skipped, count(*) FILTER (embedding IS NULL OR embedding_model <> 'm1') AS to_embed, count(*) FILTER ((embedding IS NULL OR embedding_model <> 'm1') AND id % 2 = 0) AS embedded FROM {chunks} GROUP BY 1)""",
    ),
    "page_totals": (lambda t: H.page_totals(t["conversation_pages"]), "SELECT document_id, count(*) AS n_pages, count(*) FILTER (x <> '') AS n_text_pages, CAST(sum(length(x)) AS BIGINT) AS n_characters FROM (SELECT document_id, trim(replace(text, concat(chr(13), chr(10)), chr(10))) AS x FROM {conversation_pages}) GROUP BY 1"),
    "duplicate_keys": (lambda t: H.duplicate_keys(t["documents"].select("text", "lang"), ["text", "lang"]), "SELECT text, lang, count(*) AS n FROM {documents} GROUP BY 1, 2 HAVING count(*) > 1"),
    "first_batch": (first_batch, f"SELECT run_id, place FROM (SELECT *, count(*) OVER w AS n, sum(CASE WHEN skipped THEN 0 ELSE bytes END) OVER w AS b, sum(chunks) OVER w AS c FROM {_PLACED} WINDOW w AS (PARTITION BY run_id ORDER BY place ROWS UNBOUNDED PRECEDING)) WHERE n <= 3 AND b <= 60000 AND c <= 60"),
    "budget_batches": (
        budget_batches,
        f"""WITH p AS (SELECT *, CASE WHEN skipped THEN 0 ELSE bytes END AS own, row_number() OVER (PARTITION BY run_id ORDER BY place) AS rn FROM {_PLACED}),
w AS (SELECT run_id, place, rn, 0 AS nth, 1 AS n, own AS weight, chunks AS parts, CASE WHEN own > 60000 OR chunks > 60 THEN 'over_limit' END AS refused FROM p WHERE rn = 1
  UNION ALL SELECT run_id, place, rn, nth + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN own ELSE weight + own END, CASE WHEN fresh THEN chunks ELSE parts + chunks END, CASE WHEN refused IS NOT NULL THEN 'after_refusal' WHEN own > 60000 OR chunks > 60 THEN 'over_limit' END
  FROM (SELECT p.run_id, p.place, p.rn, p.own, p.chunks, w.nth, w.n, w.weight, w.parts, w.refused, w.n + 1 > 3 OR w.weight + p.own > 60000 OR w.parts + p.chunks > 60 AS fresh FROM w JOIN p ON p.run_id = w.run_id AND p.rn = w.rn + 1))
SELECT run_id, place, CASE WHEN refused IS NULL THEN CAST(nth AS INT) END AS batch, refused FROM w""",
    ),
    "provider_batches": (lambda t: H.provider_batches(t["chunks"]).select("id", "batch"), "SELECT id, CAST(floor((row_number() OVER (PARTITION BY organization_id ORDER BY document_id, chunk_index, id) - 1) / 128) AS BIGINT) AS batch FROM {chunks}"),
    "coalesce_jobs": (lambda t: H.coalesce_jobs(t["jobs"]).select("id", "job_id", "is_duplicate"), "SELECT id, job_id, id <> job_id AS is_duplicate FROM {w_live_jobs}"),
    "current_job": (lambda t: H.current_job(t["jobs"]).select(_JOB), f"SELECT {', '.join(_JOB)} FROM {{w_live_jobs}} WHERE id = job_id"),
    "cursor_chain": (lambda t: H.cursor_chain(t["cursors"]).select("id", "scope_id", "cursor_version", "status", *_text("retired_at")), "SELECT id, scope_id, cursor_version, CASE WHEN r IS NULL THEN 'active' ELSE 'superseded' END AS status, CAST(r AS VARCHAR) AS retired_at FROM (SELECT *, lead(activated_at) OVER (PARTITION BY scope_id ORDER BY cursor_version) AS r FROM {cursors})"),
    "number_chunks": (lambda t: H.number_chunks(t["chunks"]).select("id", "number"), "SELECT id, row_number() OVER (PARTITION BY organization_id, document_id ORDER BY chunk_index, id) - 1 AS number FROM {chunks}"),
    # pages and views
    "keyset_page": (lambda t: H.keyset_page(t["items"].select("organization_id", "id"), ["organization_id", "id"], (2, 77), 50), "SELECT organization_id, id FROM {items} WHERE organization_id > 2 OR (organization_id = 2 AND id > 77) ORDER BY organization_id, id LIMIT 51"),
    "catalog_page": (lambda t: H.catalog_page(t["connectors"].select("id", "connector_type", "status"), ["id"], ("src1",), 25, status="active", connector_type="github"), "SELECT id, connector_type, status FROM {connectors} WHERE status = 'active' AND connector_type = 'github' AND id > 'src1' ORDER BY id LIMIT 26"),
    "history_page": (lambda t: H.history_page(t["cursors"].select("scope_id", "cursor_version", "phase"), ["scope_id", "cursor_version"], (5, 3), 100, phase="complete"), "SELECT scope_id, cursor_version, phase FROM {cursors} WHERE phase = 'complete' AND (scope_id > 5 OR (scope_id = 5 AND cursor_version > 3)) ORDER BY 1, 2 LIMIT 101"),
    "offset_page": (lambda t: H.offset_page(t["jobs"], [F.desc("created_at"), F.desc("id")], 3, 25).select("id"), "SELECT id FROM {jobs} ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50"),
    "newest": (lambda t: H.newest(t["docs"], [F.desc("created_at"), F.desc("id")], 500, 100).select("id", "title"), "SELECT id, title FROM {docs} ORDER BY created_at DESC, id DESC LIMIT 100"),
    "work_order": (
        work_order,
        """SELECT id, priority, row_number() OVER (ORDER BY priority, next_attempt_at NULLS FIRST, created_at, id) AS place FROM {jobs} WHERE status = 'queued'""",
    ),
    "job_history": (lambda t: H.job_history(t["jobs"], 1, 50, status="failed").select("id"), "SELECT id FROM {jobs} WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 50"),
    "runs_of_job": (lambda t: H.runs_of_job(t["events"].select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("started_at")), 5).select("id", "job_id", "place"), "SELECT event_id AS id, user_id AS job_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM {events}) WHERE place <= 5"),
    "eligible_jobs": (
        lambda t: H.eligible_jobs(t["jobs"], t["connectors"], jobs_at()).select(_JOB),
        f"SELECT {', '.join(_JOB)} FROM {{jobs}} j WHERE status IN ('queued', 'retry_wait') AND (next_attempt_at IS NULL OR next_attempt_at <= {_JOBS_AT}) AND cancel_requested_at IS NULL AND attempt_count < max_attempts AND EXISTS (SELECT 1 FROM {{connectors}} c WHERE c.id = j.connector_id AND c.organization_id = j.organization_id)",
    ),
    "expired_leases": (
        expired_leases,
        f"""SELECT id, fate, CASE WHEN fate = 'retry_wait' THEN CAST(floor((id % 11) / 10.0 * least(30 * pow(2, attempt_count - 1), 900)) AS BIGINT) END AS wait_s FROM (SELECT *, CASE WHEN cancel_requested_at IS NOT NULL THEN 'cancelled' WHEN attempt_count < max_attempts THEN 'retry_wait' ELSE 'failed' END AS fate FROM {{jobs}} WHERE status = 'running' AND lease_expires_at <= {_JOBS_AT})""",
    ),
    "retry_decision": (
        retry_decision,
        "WITH kinds(kind, category, code, retryable) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in H.FAILURE_KINDS) + """) SELECT id, kind, CASE WHEN stop THEN 'internal' ELSE category END AS category, CASE WHEN stop THEN 'execution_cancelled' ELSE code END AS code, decision,
  CASE WHEN decision = 'retry' THEN round(CASE WHEN kind = 'rate_limited' AND retry_after_seconds IS NOT NULL THEN least(retry_after_seconds, 3600) ELSE jitter * least(30 * pow(2, attempt_count - 1), 900) END, 6) END AS delay_seconds
  FROM (SELECT *, CASE WHEN stop THEN 'cancelled' WHEN NOT retryable OR attempt_count >= max_attempts THEN 'failed' ELSE 'retry' END AS decision FROM (SELECT *, cancellation_requested OR kind = 'cancelled' AS stop FROM {failures} JOIN kinds USING (kind)))""",
    ),
    "syncable_scopes": (
        lambda t: H.syncable_scopes(t["connectors"], t["scopes"], t["spaces"]),
        "SELECT s.organization_id, s.id AS connector_scope_id, s.connector_id, CASE WHEN c.status <> 'active' THEN 'connector_inactive' WHEN s.status <> 'active' THEN 'scope_inactive' WHEN k.status <> 'active' THEN 'space_inactive' END AS reason FROM {scopes} s JOIN {connectors} c ON c.id = s.connector_id JOIN {spaces} k ON k.id = s.knowledge_space_id",
    ),
    "due_schedules": (
        due_schedules,
        """SELECT connector_scope_id, reason AS paused_reason, CASE WHEN reason IS NULL THEN CAST(interval_seconds AS BIGINT) * (CAST(floor((DATE '2024-01-12' - next_run_at) * 86400 / interval_seconds) AS BIGINT) + 1) END AS after_anchor_s FROM (SELECT h.*, CASE WHEN c.status <> 'active' THEN 'connector_inactive' WHEN s.status <> 'active' THEN 'scope_inactive' WHEN NOT ((c.connector_type = 'local_folder' AND s.scope_type = 'folder') OR (c.connector_type = 'github' AND s.scope_type = 'repository')) THEN 'type_mismatch' END AS reason
  FROM {schedules} h JOIN {connectors} c ON c.id = h.connector_id JOIN (SELECT id, status, CASE WHEN id LIKE '%4:a' THEN 'other' ELSE scope_type END AS scope_type FROM {scopes}) s ON s.id = h.connector_scope_id WHERE h.status = 'active' AND h.next_run_at <= DATE '2024-01-12')""",
    ),
    "attempt_runs": (lambda t: H.attempt_runs(t["jobs"]), "SELECT id, attempt_count, CASE WHEN attempt_count > 1 THEN 'retry' ELSE mode END AS mode, CASE WHEN attempt_count > 1 THEN 'retry' ELSE trigger_type END AS trigger_type FROM {jobs} WHERE attempt_count > 0"),
    "index_backlog": (lambda t: H.index_backlog(t["index_states"], now(), reason="new_version").select("id", "status"), f"SELECT id, status FROM {{index_states}} WHERE reason = 'new_version' AND (indexed_generation IS NULL OR indexed_generation < desired_generation) AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF})"),
    # predicates and scalars
    "valid_path": (paths, "SELECT page_id, path, octet_length(encode(path)) <= 1024 AND len(string_split(path, '/')) <= 64 AND NOT contains(path, '\\') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..') OR strlen(x) > 255)) = 0 AS valid FROM (SELECT page_id, concat(regexp_replace(url, '^.*://', ''), CASE WHEN page_id % 7 = 0 THEN '/../x' WHEN page_id % 5 = 0 THEN '\\y' ELSE '' END) AS path FROM {pages})"),
    "skip_reason": (
        entries,
        """SELECT object_id, entry_type, path, CASE WHEN object_id % 17 = 0 THEN 'dropped' WHEN entry_type IS NULL OR entry_type NOT IN ('blob', 'executable') THEN 'unsupported_object_type' WHEN path NOT LIKE '%.md' THEN 'unsupported_format' WHEN size_bytes IS NULL OR object_id % 10 = 4 THEN 'size_unavailable' WHEN size_bytes > 10485760 THEN 'oversized' END AS skip_reason FROM (SELECT *, concat(name, CASE WHEN object_id % 2 = 0 THEN '.md' ELSE '.bin' END) AS path,
  CASE WHEN mode = '040000' AND object_type = 'tree' THEN 'tree' WHEN mode = '100644' AND object_type = 'blob' THEN 'blob' WHEN mode = '100755' AND object_type = 'blob' THEN 'executable' WHEN mode = '120000' AND object_type = 'blob' THEN 'symlink' WHEN mode = '160000' AND object_type = 'commit' THEN 'submodule' END AS entry_type FROM {tree})""",
    ),
    "scalar_names": (
        scalar_names,
        "SELECT id, '.md' AS suffix, concat('doc-', CAST(id AS VARCHAR)) AS stem, 'text/markdown' AS mime, concat('.', source_item_type) AS ext, concat('github:repository:', CAST(organization_id AS VARCHAR), ':path:', source_item_key) AS item_key, sha256(source_item_key) AS key_sha256, json_extract_string(source_metadata, '$.provider') AS provider, json_extract_string(source_metadata, '$.provider') = 'github' AS is_github, starts_with(source_item_key, 'src1') AS has_prefix, regexp_matches(connector_id, '^[a-z0-9]+(-[a-z0-9]+)*$') AS is_slug FROM {items}",
    ),
    "normalize_newlines": (newlines, "SELECT document_id, page_number, replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS text, page_number % 5 = 3 AS is_pointer FROM (SELECT document_id, page_number, CASE WHEN page_number % 5 = 3 THEN concat('version https://git-lfs.github.com/spec/v1', chr(13), chr(10), text) ELSE text END AS text FROM {conversation_pages})"),
    "email_domain": (domains, "SELECT id, split_part(normalized_email, '@', 2) AS domain FROM {users}"),
    "row_id": (lambda t: t["items"].select("id", X.row_id(F.col("organization_id"), F.col("source_item_key")).alias("row_id")), "SELECT id, sha256(concat('1:', CAST(organization_id AS VARCHAR), '|', CAST(strlen(source_item_key) AS VARCHAR), ':', source_item_key)) AS row_id FROM {items}"),
    "scan_after": (
        scanned_rows,
        """SELECT source_item_key AS key, organization_id, size_bytes FROM {items} WHERE source_item_key > 'src5' AND organization_id = 2""",
    ),
    "trim_unicode": (
        trimmed,
        """SELECT event_id, event_type AS trimmed FROM {events}""",
    ),
    "profile_fingerprint": (
        fingerprints,
        """SELECT id, profile_fingerprint = 'profile-1' AS is_one, sha256('{{"chunk_size":2000,"embedding_model":"m1","overlap":200}}') AS fingerprint FROM {index_states}""",
    ),
    # content
    "markdown_sections": (
        markdown_texts,
        f"""WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN concat('# Only ', CAST(doc_id AS VARCHAR), chr(10), chr(10), '## Heads ') WHEN doc_id % 6 = 2 THEN concat(' ', chr(10)) ELSE text END AS text FROM {{markdown}}), {_MD.replace("{markdown}", "texts")}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS section_index, heading, text FROM (SELECT doc_id, section, max(CASE WHEN level IS NOT NULL THEN heading END) AS heading, regexp_replace(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS text FROM parts GROUP BY 1, 2) WHERE text <> ''
UNION ALL SELECT doc_id, 0, NULL, regexp_replace(text, '\\s+$', '') FROM texts WHERE doc_id % 6 = 1""",
    ),
    "markdown_titles": (lambda t: C.markdown_titles(t["markdown"]), "SELECT doc_id, concat('Title ', CAST(doc_id AS VARCHAR)) AS title, 3 AS heading_count FROM {markdown}"),
    "assemble_pages": (lambda t: C.assemble_pages(t["conversation_pages"]).select("document_id", "text", F.col("n_sections").cast("long").alias("n_sections"), "rejected"), "SELECT document_id, CASE WHEN count(x) > 0 THEN string_agg(x, concat(chr(10), chr(10)) ORDER BY page_number) END AS text, count(x) AS n_sections, CASE WHEN count(x) = 0 THEN 'no_text' END AS rejected FROM (SELECT *, nullif(trim(replace(text, concat(chr(13), chr(10)), chr(10)), concat(' ', chr(9), chr(10))), '') AS x FROM {conversation_pages}) GROUP BY 1"),
    "page_sections": (lambda t: C.page_sections(t["conversation_pages"]), "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS section_index, concat('Page ', CAST(page_number AS VARCHAR)) AS heading, x AS text FROM (SELECT *, trim(replace(text, concat(chr(13), chr(10)), chr(10)), concat(' ', chr(9), chr(10))) AS x FROM {conversation_pages}) WHERE x <> ''"),
    "assemble_blocks": (
        blocks,
        """SELECT document_id, coalesce(string_agg(nullif(part, ''), concat(chr(10), chr(10)) ORDER BY block_index), '') AS text, count(*) FILTER (kind = 'paragraph' AND style LIKE 'Heading%' AND part <> '') AS n_headings, count(*) FILTER (kind = 'table' AND part <> '') AS n_tables FROM (SELECT *, CASE WHEN kind <> 'table' THEN trim(text) WHEN block_index % 6 = 5 THEN '' ELSE concat(concat_ws(' | ', nullif(trim(split_part(cells, '|', 1)), ''), nullif(trim(split_part(cells, '|', 3), concat(' ', chr(9), chr(10))), '')), chr(10), role, ' | ', role) END AS part FROM (SELECT *, trim(split_part(cells, '|', 1)) AS role FROM {conversation_blocks})) GROUP BY 1""",
    ),
    "route_extractor": (lambda t: C.route_extractor(t["items"].select("id", F.concat("source_item_key", F.when(F.col("id") % 3 == 0, ".TXT").when(F.col("id") % 3 == 1, ".exe").otherwise("")).alias("path"))).select("id", "extractor", "rejected"), "SELECT id, CASE id % 3 WHEN 0 THEN 'text' WHEN 2 THEN 'markdown' END AS extractor, CASE id % 3 WHEN 1 THEN 'unsupported_format' END AS rejected FROM {items}"),
    "embedding_backlog": (
        backlog,
        """SELECT id, (embedding IS NULL) <> (embedding_model IS NULL OR id % 7 = 0) AS broken FROM {chunks} WHERE embedding IS NULL OR embedding_model <> 'm1' OR id % 7 = 0""",
    ),
    "chunk_documents": (
        chunk_documents,
        r"""WITH base AS (SELECT *, length(t) AS n FROM (SELECT doc_id, replace(replace(coalesce(text, ''), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS t FROM {documents})),
  steps AS (SELECT doc_id, -1 AS i, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, n = 0 AS ended FROM base
    UNION ALL SELECT doc_id, i, greatest(e - 200, s + 1, before + 1), s, e, e >= n FROM
      (SELECT *, s + length(rtrim(substr(w, 1, wide), concat(' ', chr(9), chr(10)))) AS e FROM
        (SELECT *, CASE WHEN s + 2000 >= n THEN n - s WHEN length(paragraph) > 0 THEN length(paragraph) WHEN length(line) > 0 THEN length(line) WHEN length(sentence) > 0 THEN length(sentence) WHEN length(blank) > 0 THEN length(blank) ELSE 2000 END AS wide FROM
          (SELECT *, regexp_extract(w, '(?s)^(.*\n[ \t]*\n\s*)', 1) AS paragraph, regexp_extract(w, '(?s)^(.*\n)', 1) AS line, regexp_extract(w, '(?s)^(.*[.!?])\s', 1) AS sentence, regexp_extract(w, '(?s)^(.+)\s', 1) AS blank FROM
            (SELECT *, substr(t, s + 1, 2000) AS w FROM (SELECT x.doc_id, x.i + 1 AS i, x.at AS before, b.t, b.n, x.at + length(regexp_extract(substr(b.t, x.at + 1), '^\s*')) AS s FROM steps x JOIN base b USING (doc_id) WHERE NOT x.ended) WHERE s < n)))))
SELECT doc_id, i AS chunk_index, substr(t, s + 1, e - s) AS content, e - s AS character_count, s AS start_offset, e AS end_offset, sha256(substr(t, s + 1, e - s)) AS content_hash FROM steps JOIN base USING (doc_id) WHERE i >= 0""",
    ),
    "within_chunk_ceiling": (
        lambda t: C.within_chunk_ceiling(t["docs"], t["chunks"].union(t["chunks"].filter("id % 3 = 0")), 1),
        """SELECT d.id AS document_id, count(c.id) AS n_chunks, count(c.id) = 1 AS accepted FROM {docs} d LEFT JOIN (SELECT id, document_id FROM {chunks} UNION ALL SELECT id, document_id FROM {chunks} WHERE id % 3 = 0) c ON c.document_id = d.id GROUP BY 1""",
    ),
    "embed": (
        embed,
        """SELECT id, 'm1' AS embedding_model, 64 AS dimensions, CASE WHEN embedding IS NULL OR embedding_model <> 'm1' THEN CAST(list_sum(list_transform(range(64), lambda i: (i + 1) * CAST('0x' || substr(md5(concat(CAST(i // 16 AS VARCHAR), ':', chunk_text)), CAST(2 * (i % 16) + 1 AS INT), 2) AS BIGINT))) AS BIGINT) END AS weighed_bytes FROM {chunks}""",
    ),
    "clear_embedding": (clear_embedding, "SELECT id, CASE WHEN id % 3 <> 0 THEN embedding_model END AS embedding_model, id % 3 = 0 OR embedding IS NULL AS is_empty FROM {chunks}"),
    # sources and streams
    "expand_tree": (
        expand_tree,
        "WITH walk(path, depth, object_id, object_type) AS (SELECT name, 1, object_id, object_type FROM {tree} WHERE parent_tree_id = 0 UNION ALL SELECT concat(w.path, '/', t.name), w.depth + 1, t.object_id, t.object_type FROM walk w JOIN {tree} t ON t.parent_tree_id = w.object_id WHERE w.object_type = 'tree') SELECT path, CAST(depth AS BIGINT) AS depth, object_id, object_type FROM walk",
    ),
    "scan_files": (lambda t: S.scan_files(t.spark, t.sf_dir, [".PARQUET"]).select("key", "size_bytes"), None),
    "scan_texts": (
        scanned_texts,
        """SELECT source, strlen(content) AS size_bytes, sha256(content) AS checksum, md5(content) AS text_md5, NULL AS rejected FROM (SELECT source, string_agg(concat(CAST(doc_id AS VARCHAR), ' ', md5(text), chr(10)), '' ORDER BY doc_id) AS content FROM {documents} GROUP BY source)""",
    ),
    "silent_workers": (
        silent_workers,
        """SELECT worker, count(*) AS n_silences, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_seen FROM (SELECT user_id AS worker, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM {events}) WHERE epoch_ms(after) - epoch_ms(ts) > 129600000 GROUP BY worker""",
    ),
    "append_history": (
        append_history,
        """SELECT run_id, item_id, status, n FROM {run_items} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n)""",
    ),
    "load_table": (
        lambda t: S.load_table(t.spark, t.sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        """SELECT n_nationkey, n_name, n_regionkey FROM {nation}""",
    ),
    "silence_gaps": (heartbeats, "SELECT worker, count(*) AS n_silences FROM (SELECT user_id AS worker, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after, ts FROM {events}) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) > 21600000000 GROUP BY 1"),
    # quality
    "check_rows": (check_rows, "SELECT rule, n AS n_rows, f AS n_failed FROM (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (NOT coalesce({r}, true)) AS f{i}" for i, r in enumerate(_RULES.values())) + " FROM {items}) CROSS JOIN LATERAL (VALUES " + ", ".join(f"('{k}', f{i})" for i, k in enumerate(_RULES)) + ") AS v(rule, f)"),
    "check_tables": (check_tables, _rules_sql()),
    "check_unique": (lambda t: Q.check_unique(t["acl_entries"], ["organization_id", "source_item_id"], "effect <> 'none'"), "SELECT organization_id, source_item_id, count(*) AS n FROM {acl_entries} GROUP BY 1, 2 HAVING count(*) > 1"),
    "check_references": (
        references,
        """SELECT id, organization_id, connector_id FROM (SELECT id, organization_id, CASE WHEN id % 9 = 4 THEN concat(connector_id, 'x') WHEN id % 9 <> 5 THEN connector_id END AS connector_id FROM {jobs}) j WHERE connector_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {connectors} c WHERE c.id = j.connector_id AND c.organization_id = j.organization_id)""",
    ),
    "check_vectors": (check_vectors, "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'wrong_dimension' WHEN vec_id % 7 = 0 THEN 'not_finite' END AS fault FROM {embeddings}"),
    "check_embedding_results": (embedding_results, "SELECT vec_id AS input_index, CASE WHEN vec_id % 9 = 0 THEN 'missing' WHEN vec_id % 10 = 3 THEN 'repeated' WHEN vec_id % 8 = 1 THEN 'wrong_dimension' ELSE 'wrong_model' END AS fault FROM {embeddings} WHERE vec_id % 9 = 0 OR vec_id % 10 = 3 OR vec_id % 8 = 1 OR vec_id % 11 = 0"),
    "scan_unsafe_json": (
        unsafe_json,
        """SELECT event_id, event_id % 6 = 0 OR event_id % 10 IN (1, 3, 5, 9) AS unsafe FROM {events}""",
    ),
    "json_faults": (
        lambda t: Q.json_faults(_odd_json(t), "event_id", "props"),
        """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '$.a.Token' WHEN event_id % 10 = 1 THEN '$.note' WHEN event_id % 10 = 3 THEN '$.where[1]' WHEN event_id % 10 = 5 THEN '$.token' ELSE '$[0]' END AS path, CASE WHEN event_id % 6 = 0 OR event_id % 10 = 5 THEN 'key' ELSE 'value' END AS fault FROM {events} WHERE event_id % 6 = 0 OR event_id % 10 IN (1, 3, 5, 9)""",
    ),
    "check_tree": (
        lambda t: Q.check_tree(t["tree_names"]),
        """SELECT parent_tree_id, CAST(sum(n) AS BIGINT) AS n_entries, CAST(sum(n - d) AS BIGINT) AS n_duplicates, CAST(sum(d - 1) AS BIGINT) AS n_collisions, sum(n - d) = 0 AND sum(d - 1) = 0 AND sum(n) <= 1000 AS accepted FROM (SELECT parent_tree_id, lower(name) AS k, count(*) AS n, count(DISTINCT name) AS d FROM {tree_names} GROUP BY 1, 2) GROUP BY 1""",
    ),
    "check_chunks": (
        chunk_faults,
        """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 OR trim(substr(text, 1, 20)) = '' THEN 'blank' WHEN doc_id % 7 = 0 THEN 'wrong_length' WHEN doc_id % 11 = 0 THEN 'repeated_index' END AS fault FROM {documents} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) k WHERE k.k = 1 OR doc_id % 11 = 0""",
    ),
    "check_cursor_history": (
        lambda t: Q.check_cursor_history(t["cursors"]).select("id", "fault"),
        "SELECT id, CASE WHEN cursor_version <= v THEN 'version' WHEN r < pr THEN 'phase' WHEN total < pt THEN 'total' END AS fault FROM (SELECT *, lag(cursor_version) OVER w AS v, lag(r) OVER w AS pr, lag(total) OVER w AS pt FROM (SELECT *, CASE phase WHEN 'traversal' THEN 1 WHEN 'reconciliation' THEN 2 ELSE 3 END AS r FROM {cursors}) WINDOW w AS (PARTITION BY scope_id ORDER BY id))",
    ),
}
