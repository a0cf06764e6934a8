"""Catalogue tables derived from the driver tables, stated once in SQL that Spark and DuckDB both run.

`Tables` builds them as DataFrames; `with_tables` puts them before a DuckDB query as common table
expressions.  Names in braces are tables: of the driver, or derived ones.  Times are dates or
zone-less timestamps, so no session time zone matters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
#: The moment at which validity is judged.
AS_OF = "DATE '1998-06-01'"
RUN_START = "DATE '1998-01-01'"

DERIVED: dict[str, str] = {
    "organizations": "SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey = 4 THEN 'suspended' ELSE 'active' END AS status FROM {region}",
    "departments": "SELECT n_nationkey AS id, n_regionkey AS organization_id, CASE WHEN n_nationkey % 9 = 8 THEN 'archived' ELSE 'active' END AS status FROM {nation}",
    "users": """SELECT c_custkey AS id, n_regionkey AS organization_id, CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status,
        concat('u', CAST(c_custkey AS STRING), '@d', CAST(c_custkey % 7 AS STRING), '.example') AS normalized_email, c_nationkey AS department_id,
        concat(CAST(n_regionkey AS STRING), '-', c_mktsegment) AS team_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "teams": "SELECT DISTINCT team_id AS id, organization_id, CASE WHEN team_id LIKE '2-%' THEN 'archived' ELSE 'active' END AS status FROM {users}",
    "roles": "SELECT id AS organization_id, concat('admin-', CAST(id AS STRING)) AS id, 'org_admin' AS name FROM {organizations}",
    "user_roles": "SELECT organization_id, id AS user_id, concat('admin-', CAST(organization_id AS STRING)) AS role_id FROM {users} WHERE normalized_email LIKE 'u%0@%'",
    "department_memberships": """SELECT organization_id, department_id, id AS user_id, CASE WHEN id % 10 = 9 THEN 'suspended' ELSE 'active' END AS status,
        DATE '1995-01-01' + CAST(id % 1500 AS INT) AS effective_from, CASE WHEN id % 5 = 0 THEN DATE '1996-01-01' + CAST(id % 1500 AS INT) END AS expires_at,
        CASE WHEN id % 11 = 0 THEN DATE '1997-01-01' END AS revoked_at FROM {users}""",
    "team_memberships": """SELECT organization_id, team_id, id AS user_id, CASE WHEN id % 8 = 7 THEN 'suspended' ELSE 'active' END AS status,
        DATE '1995-01-01' + CAST(id % 1400 AS INT) AS effective_from, CASE WHEN id % 6 = 0 THEN DATE '1997-01-01' + CAST(id % 1500 AS INT) END AS expires_at,
        CASE WHEN id % 13 = 0 THEN DATE '1997-01-01' END AS revoked_at FROM {users}""",
    "spaces": "SELECT s_suppkey AS id, n_regionkey AS organization_id, CASE WHEN s_suppkey % 10 = 3 THEN 'archived' ELSE 'active' END AS status FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "numbered_spaces": "SELECT id, organization_id, row_number() OVER (PARTITION BY organization_id ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY organization_id) AS total FROM {spaces}",
    "all_grants": """SELECT u.organization_id, u.id AS user_id, u.department_id, u.team_id, s.id AS knowledge_space_id, CASE WHEN o.o_orderkey % 1000 = 3 THEN 'organization' WHEN o.o_orderkey % 20 = 1 THEN 'department' WHEN o.o_orderkey % 20 = 2 THEN 'team' ELSE 'user' END AS kind,
        CAST(o.o_orderdate AS DATE) AS granted_at, CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 400 AS INT) END AS expires_at,
        CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderdate AS DATE) + 30 END AS revoked_at
        FROM {orders} o JOIN {users} u ON o.o_custkey = u.id JOIN {numbered_spaces} s ON s.organization_id = u.organization_id AND s.place = o.o_orderkey % s.total""",
    "user_grants": "SELECT organization_id, user_id, knowledge_space_id, granted_at, expires_at, revoked_at FROM {all_grants} WHERE kind = 'user'",
    "department_grants": "SELECT organization_id, department_id, knowledge_space_id, granted_at, expires_at, revoked_at FROM {all_grants} WHERE kind = 'department'",
    "team_grants": "SELECT organization_id, team_id, knowledge_space_id, granted_at, expires_at, revoked_at FROM {all_grants} WHERE kind = 'team'",
    "organization_grants": "SELECT organization_id, knowledge_space_id, granted_at, expires_at, revoked_at FROM {all_grants} WHERE kind = 'organization'",
    "placed_documents": "SELECT doc_id, text, source, n_chars, CAST(substr(source, 4) AS INT) AS n, CAST(doc_id % 5 AS INT) AS organization_id FROM {documents}",
    "connectors": """SELECT DISTINCT concat(source, '/', CAST(organization_id AS STRING)) AS id, organization_id, n, CASE WHEN n % 2 = 0 THEN 'local_folder' ELSE 'github' END AS connector_type,
        CASE WHEN n % 7 = 6 THEN 'disabled' ELSE 'active' END AS status FROM {placed_documents}""",
    "scopes": """SELECT concat(c.id, ':', k.k) AS id, c.organization_id, c.id AS connector_id, s.id AS knowledge_space_id, CASE WHEN c.n % 2 = 0 THEN 'folder' ELSE 'repository' END AS scope_type,
        CASE (c.n + c.organization_id) % 3 WHEN 0 THEN 'platform_managed' WHEN 1 THEN 'source_acl' ELSE 'hybrid' END AS access_mode,
        CASE WHEN c.n % 9 = 8 AND k.k = 'b' THEN 'removed' ELSE 'active' END AS status, concat('key-', c.id, ':', k.k) AS external_scope_key
        FROM {connectors} c CROSS JOIN (SELECT 'a' AS k, 0 AS shift UNION ALL SELECT 'b' AS k, 3 AS shift) k
        JOIN {numbered_spaces} s ON s.organization_id = c.organization_id AND s.place = (c.n + k.shift) % s.total""",
    "items": """SELECT doc_id AS id, organization_id, concat(source, '/', CAST(organization_id AS STRING)) AS connector_id, concat(source, '/doc-', CAST(doc_id AS STRING), '.md') AS source_item_key,
        CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'page' ELSE 'message' END AS source_item_type, md5(text) AS source_checksum, n_chars AS size_bytes,
        CASE WHEN doc_id % 19 = 0 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN doc_id % 19 = 0 THEN DATE '1998-02-01' END AS deleted_at,
        DATE '1996-01-01' + CAST(doc_id % 300 AS INT) AS first_seen_at, DATE '1997-10-01' + CAST(doc_id % 200 AS INT) AS last_seen_at,
        concat('{{"provider": "', CASE WHEN n % 2 = 0 THEN 'local' ELSE 'github' END, '", "repository_id": "', CAST(n AS STRING), '"}}') AS source_metadata FROM {placed_documents}""",
    "memberships": """SELECT organization_id, connector_id, id AS source_item_id, concat(connector_id, ':', k.k) AS connector_scope_id, CASE WHEN id % 23 = 0 THEN 'removed' ELSE 'active' END AS status,
        CASE WHEN id % 23 = 0 THEN DATE '1998-03-01' END AS removed_at, DATE '1996-01-01' + CAST(id % 300 AS INT) AS first_discovered_at, DATE '1997-10-01' + CAST((id + k.shift) % 200 AS INT) AS last_seen_at
        FROM {items} CROSS JOIN (SELECT 'a' AS k, 0 AS shift UNION ALL SELECT 'b' AS k, 90 AS shift) k WHERE k.k = 'a' OR id % 4 = 0""",
    "versions": """SELECT id * 10 + v.v AS id, organization_id, id AS source_item_id, v.v AS version_number, v.v = 1 + id % 2 AS is_current, CASE WHEN v.v = 1 THEN 'discovered' ELSE 'content_changed' END AS version_cause,
        CASE WHEN id % 29 = 0 THEN 'unavailable' ELSE 'available' END AS lifecycle, CASE WHEN v.v = 1 + id % 2 THEN source_checksum ELSE md5(source_checksum) END AS content_checksum,
        DATE '1996-01-01' + CAST(id % 300 + 200 * v.v AS INT) AS discovered_at, CASE WHEN v.v = 1 + id % 2 THEN source_checksum ELSE md5(source_checksum) END AS provider_version_id,
        CASE WHEN id % 29 = 0 THEN concat('{{"reason":"', CASE WHEN id % 58 = 0 THEN 'oversized' ELSE 'unsupported_format' END, '"}}') END AS version_metadata FROM {items} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) v WHERE v.v <= 1 + id % 2""",
    "docs": """SELECT doc_id AS id, organization_id, CASE WHEN n % 2 = 0 THEN 'local_folder' ELSE 'github' END AS source_type, concat(source, '/doc-', CAST(doc_id AS STRING), '.md') AS source_document_key,
        concat('Document ', CAST(doc_id AS STRING)) AS title, md5(text) AS checksum_latest, CASE WHEN doc_id % 31 = 0 THEN 'failed' ELSE 'ready' END AS status,
        CASE WHEN doc_id % 37 = 0 THEN DATE '1998-01-15' END AS deleted_at, DATE '1996-06-01' + CAST(doc_id % 700 AS INT) AS created_at FROM {placed_documents}""",
    "mappings": "SELECT v.organization_id, v.id AS document_version_id, v.source_item_id AS document_id FROM {versions} v WHERE v.is_current",
    "all_mappings": "SELECT organization_id, id AS document_version_id, CASE WHEN is_current THEN source_item_id ELSE source_item_id + 1000000 END AS document_id FROM {versions}",
    "attempts": """SELECT s.id * 10 + k.k AS id, s.organization_id, s.id AS indexing_state_id, CAST(k.k AS INT) AS attempt_number, 'sync' AS trigger_type, CASE WHEN k.k = s.attempt_count THEN 'running' ELSE 'failed' END AS status, DATE '1998-03-01' + CAST(k.k AS INT) AS started_at,
        CASE WHEN k.k < s.attempt_count THEN DATE '1998-03-02' + CAST(k.k AS INT) END AS completed_at, CASE WHEN k.k < s.attempt_count THEN 'embedding' END AS error_category, CASE WHEN k.k < s.attempt_count THEN 'timeout' END AS error_code
        FROM {index_states} s CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) k WHERE k.k <= s.attempt_count""",
    "folder_run": """SELECT organization_id, id AS source_item_id, CASE WHEN id % 4 = 0 THEN 'succeeded' WHEN id % 4 = 2 THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN id % 14 = 0 THEN md5(concat(source_checksum, '!')) ELSE source_checksum END AS current_checksum
        FROM {items} WHERE id % 6 = 0 OR id % 5 = 1""",
    "tree_names": "SELECT parent_tree_id, name FROM {tree} UNION ALL SELECT parent_tree_id, upper(name) FROM {tree} WHERE object_id % 11 = 0 UNION ALL SELECT parent_tree_id, name FROM {tree} WHERE object_id % 13 = 0",
    "index_states": """SELECT id AS id, organization_id, id AS document_version_id, concat('profile-', CAST(source_item_id % 2 AS STRING)) AS profile_fingerprint, CASE WHEN source_item_id % 43 = 0 THEN 'm0' ELSE 'm1' END AS embedding_model,
        64 AS embedding_dimensions, 1 + source_item_id % 2 AS desired_generation, CASE WHEN source_item_id % 13 = 0 THEN source_item_id % 2 ELSE 1 + source_item_id % 2 END AS indexed_generation,
        CASE WHEN source_item_id % 13 = 0 THEN 'retry_wait' WHEN source_item_id % 47 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN source_item_id % 2 = 0 THEN 'new_version' ELSE 'profile_changed' END AS reason,
        CAST(source_item_id % 4 AS INT) AS attempt_count, CASE WHEN source_item_id % 13 = 0 THEN DATE '1998-05-01' + CAST(source_item_id % 60 AS INT) END AS next_retry_at FROM {versions}""",
    "chunks": """SELECT vec_id AS id, CAST(vec_id % t.total AS BIGINT) AS document_id, CAST((vec_id % t.total) % 5 AS INT) AS organization_id, CAST(floor(vec_id / t.total) AS INT) AS chunk_index, concat('chunk ', CAST(vec_id AS STRING)) AS chunk_text,
        CASE WHEN vec_id % 41 = 40 THEN NULL ELSE embedding END AS embedding, CASE WHEN vec_id % 41 = 40 THEN NULL WHEN vec_id % 17 = 16 THEN 'm0' ELSE 'm1' END AS embedding_model
        FROM {embeddings} CROSS JOIN (SELECT count(*) AS total FROM {documents}) t""",
    "identities": "SELECT u.organization_id, u.id AS user_id, u.normalized_email, c.id AS connector_id, concat(c.id, '#u', CAST(u.id AS STRING)) AS principal_id FROM {users} u JOIN {connectors} c ON c.organization_id = u.organization_id AND c.n = u.id % 20",
    "principals": """SELECT organization_id, connector_id, principal_id AS id, 'user' AS principal_type, normalized_email, CAST(NULL AS STRING) AS normalized_domain, CASE WHEN user_id % 33 = 0 THEN 'retired' ELSE 'active' END AS lifecycle FROM {identities}
        UNION ALL SELECT c.organization_id, c.id, concat(c.id, '#g', CAST(g.k AS STRING)), 'group', NULL, NULL, CASE WHEN g.k = 17 THEN 'retired' ELSE 'active' END FROM {connectors} c CROSS JOIN (SELECT DISTINCT CAST(id % 50 AS INT) AS k FROM {users}) g
        UNION ALL SELECT c.organization_id, c.id, concat(c.id, '#d', CAST(d.k AS STRING)), 'domain', NULL, concat('d', CAST(d.k AS STRING), '.example'), 'active' FROM {connectors} c CROSS JOIN (SELECT DISTINCT CAST(id % 7 AS INT) AS k FROM {users}) d
        UNION ALL SELECT organization_id, id, concat(id, '#any'), 'anyone', NULL, NULL, 'active' FROM {connectors}""",
    "links": """SELECT organization_id, connector_id, user_id, principal_id AS external_principal_id, CASE WHEN user_id % 8 = 7 THEN 'pending' ELSE 'verified' END AS status,
        CASE WHEN user_id % 8 <> 7 THEN DATE '1996-01-01' END AS verified_at, CASE WHEN user_id % 27 = 0 THEN DATE '1997-01-01' END AS revoked_at FROM {identities}""",
    "directories": """SELECT organization_id, id AS connector_id, CASE WHEN n % 5 = 4 THEN 'building' ELSE 'complete' END AS status, CASE WHEN n % 6 = 5 THEN NULL ELSE CAST(3 AS BIGINT) END AS current_generation,
        CASE WHEN n % 6 = 5 THEN NULL ELSE DATE '1998-05-01' END AS last_successful_at FROM {connectors}""",
    "edges": """SELECT organization_id, connector_id, concat(connector_id, '#g', CAST(user_id % 50 AS STRING)) AS group_principal_id, principal_id AS member_principal_id, CAST(1 AS BIGINT) AS first_seen_generation,
        CAST(CASE WHEN user_id % 12 = 0 THEN 2 ELSE 3 END AS BIGINT) AS last_seen_generation, 'active' AS lifecycle, CASE WHEN user_id % 21 = 0 THEN DATE '1998-01-01' END AS removed_at FROM {identities}
        UNION ALL SELECT c.organization_id, c.id, concat(c.id, '#g', CAST(CAST(floor(g.k / 2) AS INT) AS STRING)), concat(c.id, '#g', CAST(g.k AS STRING)), 1, 3, 'active', NULL
        FROM {connectors} c CROSS JOIN (SELECT DISTINCT CAST(id % 50 AS INT) AS k FROM {users}) g WHERE g.k > 0
        UNION ALL SELECT organization_id, id, concat(id, '#g3'), concat(id, '#g0'), 2, 5, 'active', NULL FROM {connectors}""",
    "snapshots": """SELECT id * 10 AS id, organization_id, connector_id, id AS source_item_id, CASE WHEN id % 14 = 5 THEN 'stale' ELSE 'complete' END AS status, id % 30 <> 7 AS is_current,
        CASE WHEN id % 22 = 9 THEN 'partial' ELSE 'complete' END AS inheritance_completeness, DATE '1998-04-01' AS captured_at, CASE WHEN id % 26 <> 3 THEN DATE '1998-04-02' END AS completed_at FROM {items}""",
    "acl_entries": """SELECT organization_id, connector_id, id AS source_item_id, id * 10 AS acl_snapshot_id,
        concat(connector_id, CASE id % 4 WHEN 0 THEN '#any' WHEN 1 THEN concat('#d', CAST(id % 7 AS STRING)) WHEN 2 THEN concat('#g', CAST(id % 50 AS STRING)) ELSE '#g1' END) AS external_principal_id,
        'allow' AS effect, CASE WHEN id % 16 = 11 THEN 'unknown' ELSE 'read' END AS permission_level, id % 18 <> 4 AS grants_read, CASE WHEN id % 17 = 0 THEN DATE '1998-05-01' END AS expires_at FROM {items}
        UNION ALL SELECT organization_id, connector_id, id, id * 10, concat(connector_id, '#g0'), 'deny', 'read', false, CASE WHEN id % 34 = 0 THEN DATE '1998-05-01' END FROM {items} WHERE id % 13 = 0""",
    "requests": """SELECT u.organization_id, u.id AS user_id, e.embedding AS query, 'm1' AS embedding_model FROM {users} u CROSS JOIN (SELECT count(*) AS total FROM {embeddings}) t JOIN {embeddings} e ON e.vec_id = u.id % t.total""",
    "manifest": """SELECT organization_id, concat(source, '/', CAST(organization_id AS STRING)) AS connector_id, concat(source, '/doc-', CAST(doc_id AS STRING), '.md') AS source_item_key,
        CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS source_checksum, n_chars AS size_bytes, doc_id % 53 = 0 AS unsupported FROM {placed_documents} WHERE doc_id % 11 <> 0
        UNION ALL SELECT organization_id, concat(source, '/', CAST(organization_id AS STRING)), concat(source, '/new-', CAST(doc_id AS STRING), '.md'), md5(concat(text, '?')), n_chars, false FROM {placed_documents} WHERE doc_id % 20 = 3""",
    "jobs": """SELECT event_id AS id, CAST(user_id % 5 AS INT) AS organization_id, concat('src', CAST(user_id % 20 AS STRING), '/', CAST(user_id % 5 AS STRING)) AS connector_id, concat('src', CAST(user_id % 20 AS STRING), '/', CAST(user_id % 5 AS STRING), ':a') AS connector_scope_id,
        CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry_wait' WHEN 'click' THEN 'succeeded' WHEN 'purchase' THEN 'running' ELSE 'failed' END AS status, CAST(event_id % 3 AS INT) AS priority, CAST(event_id % 4 AS INT) AS attempt_count, 3 AS max_attempts,
        CASE WHEN event_id % 5 < 3 THEN DATE '2024-01-02' + CAST(event_id % 40 AS INT) END AS next_attempt_at, CASE WHEN event_type = 'purchase' THEN DATE '2024-01-01' + CAST(event_id % 35 AS INT) END AS lease_expires_at,
        CASE WHEN event_id % 9 = 0 THEN DATE '2024-01-05' END AS cancel_requested_at, CAST(ts AS DATE) AS created_at, 'incremental' AS mode, 'scheduled' AS trigger_type FROM {events}""",
    "run_items": """SELECT user_id AS run_id, event_id AS item_id, CASE event_type WHEN 'signup' THEN 'new' WHEN 'click' THEN 'changed' WHEN 'view' THEN 'unchanged' WHEN 'purchase' THEN 'deleted' ELSE 'skipped' END AS change_type,
        CASE WHEN event_id % 6 = 5 THEN 'failed' ELSE 'succeeded' END AS status, md5(CAST(event_id % 900 AS STRING)) AS current_checksum FROM {events}""",
    "cursors": """SELECT event_id AS id, user_id AS scope_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cursor_version, CAST(ts AS DATE) AS activated_at,
        CASE WHEN event_id % 3 = 0 THEN 'traversal' WHEN event_id % 3 = 1 THEN 'reconciliation' ELSE 'complete' END AS phase, CAST(event_id % 100 AS BIGINT) AS total FROM {events}""",
    "schedules": """SELECT id AS connector_scope_id, organization_id, connector_id, CASE WHEN id LIKE 'src1%' THEN 'paused' ELSE 'active' END AS status, 900 + 60 * CAST(length(id) AS INT) AS interval_seconds, DATE '2024-01-01' + CAST(length(id) AS INT) AS next_run_at,
        CASE WHEN id LIKE 'src1%' THEN 'manual' END AS pause_reason_code, CASE WHEN id LIKE 'src1%' THEN DATE '2024-01-03' END AS paused_at, CASE WHEN id LIKE '%:a' THEN DATE '2023-12-31' END AS last_due_at, CASE WHEN id LIKE '%:a' THEN DATE '2024-01-01' END AS last_enqueued_at, CASE WHEN id LIKE '%:a' THEN CAST(length(id) AS BIGINT) END AS last_job_id FROM {scopes}""",
    "failures": """SELECT event_id AS id, CASE event_id % 13 WHEN 0 THEN 'retryable_provider' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'transient_network' WHEN 3 THEN 'transient_persistence' WHEN 4 THEN 'authentication' WHEN 5 THEN 'authorization' WHEN 6 THEN 'configuration'
        WHEN 7 THEN 'validation' WHEN 8 THEN 'unsupported_content' WHEN 9 THEN 'permanent_provider' WHEN 10 THEN 'cancelled' WHEN 11 THEN 'programming_error' ELSE 'unknown_internal' END AS kind,
        CAST(1 + event_id % 5 AS INT) AS attempt_count, 5 AS max_attempts, event_id % 29 = 0 AS cancellation_requested, CASE WHEN event_id % 13 = 1 AND event_id % 2 = 0 THEN CAST(event_id % 5000 AS DOUBLE) END AS retry_after_seconds,
        CAST(event_id % 101 AS DOUBLE) / 100 AS jitter FROM {events}""",
    "markdown": """SELECT doc_id, concat('# Title ', CAST(doc_id AS STRING), chr(10), text, chr(10), '## Part ', CAST(doc_id % 9 AS STRING), chr(10), source, chr(10), '#hash', chr(10), '  ### Tail  ', chr(10), chr(10), 'end') AS text, concat(source, '-', CAST(doc_id AS STRING)) AS stem FROM {documents}""",
    "tree": """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS parent_tree_id, p_partkey AS object_id, concat('n', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_partkey * 8 < t.total THEN '040000' WHEN p_partkey % 9 = 1 THEN '100755' WHEN p_partkey % 9 = 2 THEN '120000' WHEN p_partkey % 9 = 3 THEN '160000' ELSE '100644' END AS mode,
        CASE WHEN p_partkey * 8 < t.total THEN 'tree' WHEN p_partkey % 9 = 3 THEN 'commit' ELSE 'blob' END AS object_type, CASE WHEN p_partkey * 8 >= t.total THEN CAST(p_size AS BIGINT) * 400000 END AS size_bytes
        FROM {part} CROSS JOIN (SELECT count(*) AS total FROM {part}) t WHERE p_partkey > 0""",
    "batches": "SELECT l_orderkey AS run_id, l_linenumber AS batch, CAST(l_quantity AS BIGINT) AS entries, CAST(l_quantity / 5 AS BIGINT) AS files, CAST(l_extendedprice AS BIGINT) AS bytes, CAST(l_quantity AS BIGINT) * 3 AS chunks FROM {lineitem}",
    "conversation_pages": "SELECT conv_id AS document_id, turn + 1 AS page_number, CASE WHEN turn % 5 = 4 THEN '  ' ELSE replace(text, '. ', concat('.', chr(13), chr(10))) END AS text FROM {conversations}",
    "conversation_blocks": "SELECT conv_id AS document_id, turn AS block_index, CASE WHEN turn % 3 = 2 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN turn % 4 = 0 THEN 'Heading 1' ELSE 'Normal' END AS style, text, concat(role, '|', '|', replace(substr(text, 1, 12), '|', '/')) AS cells FROM {conversations}",
}


#: The same rows in a form for Spark: with `s.total` in it the place is no key of a join, and each order would meet all
#: spaces of its tenant.  Totals are a row for each tenant.
SPARK_FORMS: dict[str, str] = {
    "all_grants": DERIVED["all_grants"]
    .replace("SELECT u.", "SELECT /*+ BROADCAST(t) */ u.", 1)
    .replace("JOIN {numbered_spaces} s", "JOIN (SELECT DISTINCT organization_id, total FROM {numbered_spaces}) t ON t.organization_id = u.organization_id JOIN {numbered_spaces} s")
    .replace("% s.total", "% t.total"),
}

#: Small tables that many others are derived from: built once.
SHARED = frozenset(["connectors", "numbered_spaces", "teams"])


class Tables:
    """The tables of one folder by name, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            df = self.sql(SPARK_FORMS.get(name, DERIVED[name])) if name in DERIVED else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._known[name] = df.persist() if name in SHARED else df
        return self._known[name]

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query, **{n: self[n] for n in _names(query)})


def _names(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", query)))


def with_tables(query: str, views: dict[str, str] | None = None) -> str:
    """The query for DuckDB, with the derived tables and views that it needs before it."""
    known = DERIVED | (views or {})
    order: list[str] = []

    def visit(q: str) -> None:
        for n in _names(q):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(query)
    plain = lambda q: re.sub(r"(?<!\{)\{(\w+)\}", r"\1", q).replace("{{", "{").replace("}}", "}")
    parts = [f"{n} AS ({plain(known[n])})" for n in order]
    body = plain(query).strip()
    own = re.match(r"WITH (?=\w)", body)
    if own:
        return f"WITH RECURSIVE {', '.join([*parts, ''])}{body[own.end() :]}"
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
