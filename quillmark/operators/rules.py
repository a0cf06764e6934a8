"""Rules on the rows of the catalogue's tables, made from what is stated of their columns.

A rule speaks of columns that a table has; of a table that lacks one of them it is left out.  As in databases, a
rule that comes out null holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillmark.functions.scalars import PATTERNS
from quillmark.operators.quality import check_rows

_JOB_ENDS = ("succeeded", "failed", "cancelled")

# What is stated of each table.  filled: not blank; codes, slugs, profiles: of these forms; one_of: of these
# values; positive, natural: numbers; ordered: the first not after the second; before: the first before the second; timed: set if and only if the status is the
# named one; paired: both null or neither; needs: set only if the other is.
STATED: dict[str, dict] = {
    "organizations": {"filled": ["name"], "one_of": {"status": ("active", "suspended", "archived")}},
    "users": {"filled": ["normalized_email"], "one_of": {"status": ("active", "disabled", "invited")}},
    "connectors": {
        "codes": ["connector_type"], "filled": ["display_name"], "slugs": ["slug"], "positive": ["config_schema_version"], "timed": {"archived_at": "archived"},
        "one_of": {"status": ("draft", "validating", "active", "degraded", "auth_failed", "paused", "archived"), "acl_support": ("none", "partial", "complete")},
    },
    "scopes": {
        "codes": ["scope_type"], "filled": ["display_name", "external_scope_key"], "slugs": ["slug"], "positive": ["config_schema_version"], "timed": {"removed_at": "removed"},
        "one_of": {"access_mode": ("platform_managed", "source_acl", "hybrid"), "status": ("draft", "validating", "active", "invalid", "paused", "removed")},
    },
    "items": {
        "filled": ["source_item_key", "source_item_type", "parent_source_item_key", "source_checksum"], "codes": ["source_item_type"], "natural": ["size_bytes"], "positive": ["metadata_schema_version"],
        "one_of": {"status": ("active", "unavailable", "deleted")}, "ordered": [("first_seen_at", "last_seen_at")], "timed": {"deleted_at": "deleted"},
    },
    "memberships": {"one_of": {"status": ("active", "removed")}, "ordered": [("first_discovered_at", "last_seen_at")], "timed": {"removed_at": "removed"}},
    "schedules": {
        "one_of": {"status": ("active", "paused")}, "codes": ["pause_reason_code"], "timed": {"paused_at": "paused"}, "between": {"interval_seconds": (900, 2_592_000)}, "needs": [("last_enqueued_at", "last_due_at"), ("pause_reason_code", "paused_at")],
        "ordered": [("last_due_at", "last_enqueued_at")],
    },
    "jobs": {
        "one_of": {"status": ("queued", "running", "retry_wait", *_JOB_ENDS)}, "natural": ["attempt_count"], "between": {"max_attempts": (1, 5)}, "ordered": [("attempt_count", "max_attempts"), ("lease_acquired_at", "lease_expires_at"), ("lease_acquired_at", "heartbeat_at"), ("created_at", "cancel_requested_at"), ("created_at", "completed_at")],
        "codes": ["cancel_reason_code", "last_error_code"], "filled": ["last_error_summary"], "paired": [("last_error_category", "last_error_code")], "needs": [("cancel_reason_code", "cancel_requested_at")],
        "more": {"waiting_has_time": "(status in ('queued', 'retry_wait')) = (next_attempt_at is not null)", "running_has_lease": "(status = 'running') = (lease_expires_at is not null)", "retry_has_attempts": "status <> 'retry_wait' or (attempt_count > 0 and attempt_count < max_attempts)", "ended_has_attempts": "status not in ('succeeded', 'failed') or attempt_count > 0", "cancelled_was_asked": "status <> 'cancelled' or cancel_requested_at is not null"},
    },
    "run_items": {"one_of": {"change_type": ("new", "changed", "unchanged", "deleted", "skipped"), "status": ("pending", "processing", "succeeded", "failed", "skipped")}, "natural": ["attempt_count"]},
    "cursors": {"positive": ["cursor_version"], "natural": ["total"], "one_of": {"phase": ("traversal", "reconciliation", "complete"), "state": ("active", "superseded")}},
    "versions": {
        "positive": ["version_number"], "filled": ["provider_version_id", "content_checksum"], "natural": ["source_size_bytes"], "paired": [("content_checksum", "checksum_algorithm")],
        "one_of": {"version_cause": ("discovered", "content_changed", "metadata_changed", "restored", "tombstone", "manual_backfill"), "lifecycle": ("available", "unavailable", "deleted")},
        "more": {"tombstone_is_empty": "version_cause <> 'tombstone' or (lifecycle in ('unavailable', 'deleted') and content_checksum is null)", "deleted_is_tombstone": "lifecycle <> 'deleted' or version_cause = 'tombstone'"},
    },
    "index_states": {
        "profiles": ["profile_fingerprint", "embedding_model"], "positive": ["embedding_dimensions", "desired_generation", "indexed_generation"], "natural": ["attempt_count"], "ordered": [("indexed_generation", "desired_generation"), ("started_at", "completed_at")],
        "one_of": {"status": ("pending", "processing", "indexed", "stale", "failed", "cancelled"), "reason": ("new_version", "content_changed", "profile_changed", "embedding_model_changed", "manual_backfill", "repair")}, "paired": [("last_error_category", "last_error_code")],
        "more": {"retry_is_open": "next_retry_at is null or status in ('pending', 'failed')", "indexed_is_current": "status <> 'indexed' or indexed_generation = desired_generation"},
    },
    "attempts": {
        "positive": ["attempt_number"], "one_of": {"status": ("running", *_JOB_ENDS), "trigger_type": ("sync", "retry", "manual_backfill", "scheduled_backfill", "repair")}, "codes": ["error_category", "error_code"], "paired": [("error_category", "error_code")], "ordered": [("started_at", "completed_at")],
        "more": {"running_is_open": "(status = 'running') = (completed_at is null)", "success_has_no_error": "status <> 'succeeded' or error_category is null", "failure_has_error": "status <> 'failed' or error_category is not null"},
    },
    "principals": {"one_of": {"principal_type": ("user", "group", "domain", "anyone"), "lifecycle": ("active", "suspended", "deleted", "retired")}, "filled": ["normalized_email", "normalized_domain"], "more": {"domain_has_name": "principal_type <> 'domain' or normalized_domain is not null"}},
    "links": {"one_of": {"status": ("pending", "verified", "rejected", "revoked")}, "ordered": [("verified_at", "revoked_at")], "more": {"verified_has_time": "status <> 'verified' or verified_at is not null"}},
    "directories": {"one_of": {"status": ("building", "syncing", "complete", "stale", "failed")}, "natural": ["current_generation"], "needs": [("last_successful_at", "current_generation")]},
    "edges": {"one_of": {"lifecycle": ("active", "removed")}, "positive": ["first_seen_generation"], "ordered": [("first_seen_generation", "last_seen_generation")], "more": {"no_own_member": "group_principal_id <> member_principal_id"}},
    "snapshots": {"one_of": {"status": ("building", "complete", "stale", "failed"), "inheritance_completeness": ("unknown", "partial", "complete")}, "ordered": [("captured_at", "completed_at")], "more": {"complete_has_time": "status <> 'complete' or completed_at is not null"}},
    "acl_entries": {"one_of": {"effect": ("allow", "deny"), "permission_level": ("unknown", "read", "write", "owner")}, "more": {"deny_grants_nothing": "effect <> 'deny' or not grants_read"}},
    "docs": {"filled": ["title", "source_type", "source_document_key", "checksum_latest"], "one_of": {"status": ("pending", "processing", "ready", "failed")}, "ordered": [("created_at", "deleted_at")]},
    "departments": {"filled": ["name"], "codes": ["code"], "slugs": ["slug"], "one_of": {"status": ("active", "inactive", "archived")}, "timed": {"archived_at": "archived"}, "more": {"no_own_parent": "parent_department_id <> id"}},
    "teams": {"filled": ["name"], "slugs": ["slug"], "one_of": {"status": ("active", "inactive", "archived")}, "timed": {"archived_at": "archived"}},
    "spaces": {"filled": ["name"], "slugs": ["slug"], "one_of": {"status": ("draft", "active", "archived")}, "timed": {"archived_at": "archived"}},
    **{f"{kind}_grants": {"one_of": {"permission_level": ("viewer", "contributor", "manager")}, "before": [("granted_at", "expires_at")], "ordered": [("granted_at", "revoked_at")]} for kind in ("organization", "department", "team", "user")},
    **{f"{kind}_memberships": {"one_of": {"status": ("active", "suspended", "revoked")}, "before": [("effective_from", "expires_at")], "ordered": [("effective_from", "revoked_at")], "timed": {"revoked_at": "revoked"}} for kind in ("department", "team")},
    "settings": {"between": {"retention_days": (1, 3650)}, "filled": ["ai_model_name"]},
    "roles": {"filled": ["name"]},
    "runs": {
        "one_of": {"mode": ("initial", "incremental", "retry", "reconciliation"), "trigger_type": ("manual", "scheduled", "webhook", "retry", "system"), "status": ("queued", "running", "cancelling", "cancelled", "completed", "completed_with_errors", "failed")},
        "ordered": [("started_at", "finished_at"), ("started_at", "heartbeat_at"), ("started_at", "cancel_requested_at")], "filled": ["error_summary"], "paired": [("sync_job_id", "job_attempt_number")], "positive": ["job_attempt_number"], "needs": [("cancel_requested_at", "started_at")],
        "natural": [f"items_{x}" for x in ("discovered", "new", "changed", "unchanged", "deleted", "skipped", "succeeded", "failed")],
        "more": {
            "queued_is_new": "status <> 'queued' or (started_at is null and finished_at is null)", "open_has_begun": "status not in ('running', 'cancelling') or (started_at is not null and finished_at is null)",
            "ended_has_times": "status in ('queued', 'running', 'cancelling') or (started_at is not null and finished_at is not null)", "cancelling_was_asked": "status <> 'cancelling' or cancel_requested_at is not null", "no_own_parent": "parent_run_id <> id",
        },
    },
    "errors": {"filled": ["message"], "codes": ["error_code"], "positive": ["attempt_number"], "ordered": [("occurred_at", "retry_after_at"), ("occurred_at", "resolved_at")]},
    "audit_events": {
        "one_of": {"actor_type": ("user", "system", "service"), "outcome": ("success", "failure", "denied")}, "filled": ["action", "resource_type", "reason", "request_id", "actor_reference"], "positive": ["schema_version"],
        "more": {"user_is_named": "(actor_type = 'user') = (actor_user_id is not null)", "other_has_reference": "actor_type = 'user' or actor_reference is not null"},
    },
    "chunks": {"natural": ["chunk_index", "token_count"], "filled": ["chunk_text", "embedding_model"], "paired": [("embedding", "embedding_model")]},
}


def _form(column: str, pattern: str) -> str:
    return f"{column} rlike '{pattern}'"


def rules_of(table: str, columns: Sequence[str]) -> dict[str, str]:
    """name to SQL condition of every rule of the table that speaks of these columns only."""
    stated, there = STATED[table], set(columns)
    out: dict[str, str] = {}

    def rule(name: str, condition: str, *needed: str) -> None:
        if there.issuperset(needed):
            out[name] = condition

    for c in stated.get("filled", ()):
        rule(f"{c}_filled", f"trim({c}) <> ''", c)
    for kind, pattern in (("codes", "code"), ("slugs", "slug"), ("profiles", "profile")):
        for c in stated.get(kind, ()):
            rule(f"{c}_is_{pattern}", _form(c, PATTERNS[pattern]), c)
    for c, values in stated.get("one_of", {}).items():
        rule(f"{c}_known", f"{c} in ({', '.join(repr(v) for v in values)})", c)
    for c in stated.get("positive", ()):
        rule(f"{c}_positive", f"{c} > 0", c)
    for c in stated.get("natural", ()):
        rule(f"{c}_natural", f"{c} >= 0", c)
    for c, (low, high) in stated.get("between", {}).items():
        rule(f"{c}_in_range", f"{c} between {low} and {high}", c)
    for a, b in stated.get("ordered", ()):
        rule(f"{a}_then_{b}", f"{a} <= {b}", a, b)
    for a, b in stated.get("before", ()):
        rule(f"{a}_before_{b}", f"{a} < {b}", a, b)
    for c, status in stated.get("timed", {}).items():
        rule(f"{c}_if_{status}", f"(status = '{status}') = ({c} is not null)", c, "status")
    for a, b in stated.get("paired", ()):
        rule(f"{a}_with_{b}", f"({a} is null) = ({b} is null)", a, b)
    for a, b in stated.get("needs", ()):
        rule(f"{a}_needs_{b}", f"{a} is null or {b} is not null", a, b)
    for name, condition in stated.get("more", {}).items():
        rule(name, condition, *(w for w in re.findall(r"[a-z_]+", re.sub("'[^']*'", "", condition)) if w not in _WORDS))
    return out


_WORDS = frozenset(["in", "is", "not", "null", "or", "and"])


def check_table(df: DataFrame, table: str) -> DataFrame:
    """(table, rule, n_rows, n_failed) of every rule of the table, in one pass over df."""
    return check_rows(df, rules_of(table, df.columns)).select(F.lit(table).alias("table"), "rule", "n_rows", "n_failed")
