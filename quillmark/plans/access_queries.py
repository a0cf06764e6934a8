"""Queries over access and search, and the SQL that states the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from quillmark.functions import predicates as P
from quillmark.operators import access as A, permissions as R, search as S, vector_index as V
from quillmark.plans.fixtures import AS_OF, Tables
from quillmark.storage import cut, few, shared_folder

DIMENSIONS, K = 64, 10
_VALID = f"granted_at <= {AS_OF} AND (expires_at IS NULL OR expires_at > {AS_OF}) AND revoked_at IS NULL"
_HELD = f"status = 'active' AND effective_from <= {AS_OF} AND (expires_at IS NULL OR expires_at > {AS_OF}) AND revoked_at IS NULL"
_ENTRIES = f"""FROM {{snapshots}} s JOIN {{acl_entries}} e ON e.organization_id = s.organization_id AND e.connector_id = s.connector_id AND e.source_item_id = s.source_item_id AND e.acl_snapshot_id = s.id
  JOIN {{v_principals}} p ON p.organization_id = e.organization_id AND p.connector_id = e.connector_id AND p.principal_id = e.external_principal_id
  WHERE s.is_current AND s.status = 'complete' AND s.inheritance_completeness = 'complete' AND s.completed_at IS NOT NULL AND s.captured_at IS NOT NULL AND (e.expires_at IS NULL OR e.expires_at > {AS_OF})"""

VIEWS = {
    "v_granted": f"""SELECT organization_id, u.id AS user_id, knowledge_space_id FROM {{users}} u JOIN (SELECT * FROM {{organization_grants}} WHERE {_VALID}) g USING (organization_id) WHERE u.status = 'active'
  UNION SELECT g.organization_id, g.user_id, g.knowledge_space_id FROM {{user_grants}} g JOIN {{users}} u ON u.id = g.user_id AND u.organization_id = g.organization_id WHERE u.status = 'active' AND {_VALID}
  UNION SELECT g.organization_id, m.user_id, g.knowledge_space_id FROM (SELECT * FROM {{department_grants}} WHERE {_VALID}) g JOIN (SELECT * FROM {{department_memberships}} WHERE {_HELD}) m USING (organization_id, department_id)
    JOIN {{departments}} d ON d.id = department_id AND d.organization_id = g.organization_id AND d.status = 'active' JOIN {{users}} u ON u.id = m.user_id AND u.organization_id = g.organization_id AND u.status = 'active'
  UNION SELECT g.organization_id, m.user_id, g.knowledge_space_id FROM (SELECT * FROM {{team_grants}} WHERE {_VALID}) g JOIN (SELECT * FROM {{team_memberships}} WHERE {_HELD}) m USING (organization_id, team_id)
    JOIN {{teams}} t ON t.id = team_id AND t.organization_id = g.organization_id AND t.status = 'active' JOIN {{users}} u ON u.id = m.user_id AND u.organization_id = g.organization_id AND u.status = 'active'""",
    "v_identities": """SELECT l.organization_id, l.user_id, l.connector_id, p.id AS principal_id, p.normalized_email FROM {links} l JOIN {users} u ON u.id = l.user_id AND u.organization_id = l.organization_id AND u.status = 'active'
  JOIN {principals} p ON p.organization_id = l.organization_id AND p.connector_id = l.connector_id AND p.id = l.external_principal_id
  WHERE l.status = 'verified' AND l.verified_at IS NOT NULL AND l.revoked_at IS NULL AND p.principal_type = 'user' AND p.lifecycle = 'active'""",
    "v_directories": "SELECT organization_id, connector_id, current_generation FROM {directories} WHERE current_generation > 0 AND last_successful_at IS NOT NULL AND status IN ('complete', 'syncing', 'stale', 'failed')",
    "v_edges": """SELECT e.organization_id, e.connector_id, e.group_principal_id, e.member_principal_id FROM {edges} e JOIN {v_directories} d USING (organization_id, connector_id)
  WHERE e.lifecycle = 'active' AND e.removed_at IS NULL AND d.current_generation BETWEEN e.first_seen_generation AND e.last_seen_generation""",
    "v_steps": "SELECT e.* FROM {v_edges} e JOIN {principals} g ON g.organization_id = e.organization_id AND g.connector_id = e.connector_id AND g.id = e.group_principal_id AND g.principal_type = 'group' AND g.lifecycle = 'active'",
    "v_walk": """SELECT organization_id, user_id, connector_id, principal_id, 0 AS depth FROM {v_identities}
  UNION SELECT w.organization_id, w.user_id, w.connector_id, s.group_principal_id, w.depth + 1 FROM v_walk w JOIN {v_steps} s ON s.organization_id = w.organization_id AND s.connector_id = w.connector_id AND s.member_principal_id = w.principal_id WHERE w.depth < 16""",
    "v_closure": "SELECT organization_id, user_id, connector_id, principal_id, min(depth) AS depth FROM {v_walk} WHERE depth > 0 GROUP BY ALL",
    "v_principals": """SELECT organization_id, user_id, connector_id, principal_id FROM {v_identities} UNION SELECT organization_id, user_id, connector_id, principal_id FROM {v_closure}
  UNION SELECT i.organization_id, i.user_id, i.connector_id, p.id FROM {v_identities} i JOIN {principals} p ON p.organization_id = i.organization_id AND p.connector_id = i.connector_id AND p.principal_type = 'domain' AND p.lifecycle = 'active'
    AND p.normalized_domain = split_part(i.normalized_email, '@', 2) WHERE position('@' IN i.normalized_email) > 1
  UNION SELECT p.organization_id, u.id, p.connector_id, p.id FROM {principals} p JOIN {users} u ON u.organization_id = p.organization_id AND u.status = 'active' WHERE p.principal_type = 'anyone' AND p.lifecycle = 'active'""",
    "v_paths": """SELECT m.organization_id, m.source_item_id, m.connector_scope_id, c.knowledge_space_id, m.connector_id, c.access_mode, i.source_item_type FROM {memberships} m
  JOIN {scopes} c ON c.id = m.connector_scope_id AND c.organization_id = m.organization_id AND c.connector_id = m.connector_id AND c.status = 'active' JOIN {connectors} k ON k.id = m.connector_id AND k.organization_id = m.organization_id AND k.status = 'active'
  JOIN {spaces} s ON s.id = c.knowledge_space_id AND s.organization_id = m.organization_id AND s.status = 'active' JOIN {items} i ON i.id = m.source_item_id AND i.organization_id = m.organization_id AND i.connector_id = m.connector_id AND i.status = 'active' AND i.deleted_at IS NULL
  WHERE m.status = 'active' AND m.removed_at IS NULL""",
    "v_allowed": f"SELECT DISTINCT e.organization_id, e.connector_id, e.source_item_id, p.user_id {_ENTRIES} AND e.effect = 'allow' AND e.grants_read AND e.permission_level <> 'unknown'",
    "v_denied": f"SELECT DISTINCT e.organization_id, e.connector_id, e.source_item_id, p.user_id {_ENTRIES} AND e.effect = 'deny'",
    "v_judged": """SELECT u.id AS user_id, p.*, g.user_id IS NOT NULL AS granted, a.user_id IS NOT NULL AS allowed, d.user_id IS NOT NULL AS denied FROM {v_paths} p JOIN {users} u ON u.organization_id = p.organization_id AND u.status = 'active'
  LEFT JOIN {v_granted} g ON g.user_id = u.id AND g.organization_id = p.organization_id AND g.knowledge_space_id = p.knowledge_space_id
  LEFT JOIN {v_allowed} a ON a.user_id = u.id AND a.organization_id = p.organization_id AND a.connector_id = p.connector_id AND a.source_item_id = p.source_item_id
  LEFT JOIN {v_denied} d ON d.user_id = u.id AND d.organization_id = p.organization_id AND d.connector_id = p.connector_id AND d.source_item_id = p.source_item_id""",
    "v_authorized": """SELECT organization_id, user_id, source_item_id, connector_scope_id, knowledge_space_id, connector_id, access_mode FROM {v_judged}
  WHERE CASE access_mode WHEN 'platform_managed' THEN granted WHEN 'source_acl' THEN allowed AND NOT denied ELSE granted AND allowed AND NOT denied END""",
    "v_first": "SELECT * FROM {v_authorized} QUALIFY row_number() OVER (PARTITION BY organization_id, user_id, source_item_id ORDER BY connector_scope_id) = 1",
    "v_content": """SELECT v.organization_id, d.id AS document_id, v.id AS document_version_id, v.source_item_id, c.id AS chunk_id, c.chunk_index, c.chunk_text, d.title AS document_title, d.source_type, d.source_document_key, c.embedding, c.embedding_model
  FROM {versions} v JOIN {mappings} m ON m.document_version_id = v.id AND m.organization_id = v.organization_id JOIN {docs} d ON d.id = m.document_id AND d.organization_id = v.organization_id JOIN {chunks} c ON c.document_id = d.id AND c.organization_id = v.organization_id
  WHERE v.is_current AND v.lifecycle = 'available' AND d.status = 'ready' AND d.deleted_at IS NULL AND c.embedding IS NOT NULL""",
    "v_indexed": """SELECT c.* FROM {v_content} c WHERE EXISTS (SELECT 1 FROM {index_states} s WHERE s.organization_id = c.organization_id AND s.document_version_id = c.document_version_id AND s.embedding_model = c.embedding_model AND s.status = 'indexed'
  AND s.indexed_generation = s.desired_generation AND s.embedding_dimensions = 64)""",
}


def now():
    return F.expr(AS_OF)


def _distance(a: str, b: str) -> str:
    return f"round(1.0 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _units(t: Tables) -> tuple[dict, dict]:
    return {"department": t["department_memberships"], "team": t["team_memberships"]}, {"department": t["departments"], "team": t["teams"]}


def _grants(t: Tables) -> dict[str, DataFrame]:
    return {"organization": t["organization_grants"], "department": t["department_grants"], "team": t["team_grants"], "user": t["user_grants"]}


def _granted(t: Tables) -> DataFrame:
    return A.granted_spaces(t["users"], _grants(t), *_units(t), now())


def _identities(t: Tables) -> DataFrame:
    return A.verified_identities(t["users"], t["links"], t["principals"])


def _edges(t: Tables) -> DataFrame:
    return A.edges_at_generation(t["edges"], A.usable_directories(t["directories"]))


def _principals(t: Tables) -> DataFrame:
    return A.resolved_principals(t["users"], t["links"], t["principals"], t["directories"], t["edges"])


def _paths(t: Tables) -> DataFrame:
    return A.scope_paths(t["memberships"], t["scopes"], t["connectors"], t["spaces"], t["items"])


def _named(t: Tables) -> DataFrame:
    return A.named_principals(t["users"], t["links"], t["principals"], t["directories"], t["edges"])


def _lists(t: Tables) -> R.AccessLists:
    return R.access_lists(t["snapshots"], t["acl_entries"], A.everyone_principals(t["principals"]), now())


def _access(t: Tables) -> R.ClassAccess:
    paths = cut(_paths(t))
    spaces = few(paths.select("organization_id", "knowledge_space_id").distinct())
    named = A.named_grants(t["users"], _grants(t), *_units(t), now(), spaces)
    return R.class_access(paths, t["users"], A.tenant_grants(t["organization_grants"], now()), named, _named(t), _lists(t))


def _authorized(t: Tables) -> DataFrame:
    access = _access(t)
    return R.expand(R.by_user_class(access), access)


def _first_paths(t: Tables) -> DataFrame:
    access = _access(t)
    return R.expand(R.first_path_per_class(R.by_user_class(access)), access)


_PATH = ["organization_id", "user_id", "source_item_id", "connector_scope_id", "knowledge_space_id", "connector_id", "access_mode"]
_HIT = ["organization_id", "user_id", "rank", "chunk_id", "document_id", "document_version_id", "source_item_id", "knowledge_space_id", "connector_scope_id", "chunk_index", "chunk_text", "document_title", "source_type", "source_document_key", "embedding_model"]


def _content(t: Tables) -> DataFrame:
    return S.indexable_content(t["versions"], t["mappings"], t["docs"], t["chunks"])


def permitted_search(t: Tables) -> DataFrame:
    found = S.permitted_search(_access(t), _content(t), t["index_states"], t["requests"], K, DIMENSIONS)
    return found.select(*_HIT, F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def vector_topk(t: Tables) -> DataFrame:
    query = t["embeddings"].filter("vec_id = 0").first()["embedding"]
    near = S.vector_topk(t["embeddings"], query, K, key="vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def indexed_topk(t: Tables) -> DataFrame:
    """The same by blocks around pivots."""
    query = t["embeddings"].filter("vec_id = 0").first()["embedding"]
    place = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    V.build_index(t["embeddings"], place, key="vec_id")
    near = V.indexed_topk(t.spark, place, query, K, key="vec_id").rows
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def vector_topk_batch(t: Tables) -> DataFrame:
    return S.vector_topk_batch(t["chunks"], t["requests"], K).select("organization_id", "user_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


def optional_filters(t: Tables) -> DataFrame:
    kept = P.only_ids(P.only_ids(_paths(t), "source_item_type", ["file", "page"]), "knowledge_space_id", None)
    return P.for_tenant(kept, 1).select("source_item_id", "connector_scope_id", "source_item_type")


def owned_ids(t: Tables) -> DataFrame:
    wanted = t["user_grants"].select("organization_id", (F.col("knowledge_space_id") + 1).alias("id"))
    return A.owned_ids(t["spaces"], wanted)


_NEAREST = f"SELECT vec_id, {_distance('embedding', 'q')} AS distance, round(1 - {_distance('embedding', 'q')}, 6) AS similarity FROM {{embeddings}} CROSS JOIN (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) ORDER BY 1.0 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), vec_id LIMIT {K}"

QUERIES = {
    "vector_topk": (vector_topk, _NEAREST),
    "indexed_topk": (indexed_topk, _NEAREST),
    "vector_topk_batch": (
        vector_topk_batch,
        f"""SELECT organization_id, user_id, chunk_id, rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, user_id ORDER BY d, chunk_id) AS rank FROM
  (SELECT r.organization_id, r.user_id, c.id AS chunk_id, 1.0 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.query AS DOUBLE[])) AS d FROM {{requests}} r JOIN {{chunks}} c ON c.organization_id = r.organization_id AND c.embedding_model = r.embedding_model WHERE c.embedding IS NOT NULL)) WHERE rank <= {K}""",
    ),
    "permitted_search": (
        permitted_search,
        f"""SELECT {", ".join(_HIT)}, round(d, 6) AS distance, round(1.0 - d, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, user_id ORDER BY d, chunk_id) AS rank FROM
  (SELECT f.user_id, f.knowledge_space_id, f.connector_scope_id, i.*, 1.0 - list_cosine_similarity(CAST(i.embedding AS DOUBLE[]), CAST(r.query AS DOUBLE[])) AS d FROM {{v_first}} f JOIN {{v_indexed}} i ON i.organization_id = f.organization_id AND i.source_item_id = f.source_item_id
   JOIN {{requests}} r ON r.organization_id = f.organization_id AND r.user_id = f.user_id AND r.embedding_model = i.embedding_model)) WHERE rank <= {K}""",
    ),
    "granted_spaces": (_granted, "SELECT * FROM {v_granted}"),
    "verified_identities": (_identities, "SELECT * FROM {v_identities}"),
    "usable_directories": (lambda t: A.usable_directories(t["directories"]), "SELECT * FROM {v_directories}"),
    "edges_at_generation": (_edges, "SELECT * FROM {v_edges}"),
    "group_closure": (lambda t: A.group_closure(_identities(t), _edges(t), t["principals"]).withColumn("depth", F.col("depth").cast("long")), "SELECT organization_id, user_id, connector_id, principal_id, CAST(depth AS BIGINT) AS depth FROM {v_closure}"),
    "domain_principals": (
        lambda t: A.domain_principals(_identities(t), t["principals"]),
        "SELECT i.organization_id, i.user_id, i.connector_id, p.id AS principal_id FROM {v_identities} i JOIN {principals} p ON p.connector_id = i.connector_id AND p.organization_id = i.organization_id AND p.principal_type = 'domain' AND p.normalized_domain = split_part(i.normalized_email, '@', 2)",
    ),
    "anyone_principals": (lambda t: A.anyone_principals(t["users"], t["principals"]), "SELECT p.organization_id, p.connector_id, p.id AS principal_id, u.id AS user_id FROM {principals} p JOIN {users} u USING (organization_id) WHERE p.principal_type = 'anyone' AND u.status = 'active'"),
    "resolved_principals": (_principals, "SELECT * FROM {v_principals}"),
    "scope_paths": (_paths, "SELECT * FROM {v_paths}"),
    "optional_filters": (optional_filters, "SELECT source_item_id, connector_scope_id, source_item_type FROM {v_paths} WHERE organization_id = 1 AND source_item_type IN ('file', 'page')"),
    "acl_allowed": (lambda t: R.acl_allowed(t["users"], _named(t), _lists(t)), "SELECT * FROM {v_allowed}"),
    "acl_denied": (lambda t: R.acl_denied(t["users"], _named(t), _lists(t)), "SELECT * FROM {v_denied}"),
    "authorized_paths": (lambda t: _authorized(t).select(_PATH), "SELECT * FROM {v_authorized}"),
    "first_path_per_item": (lambda t: _first_paths(t).select(_PATH), "SELECT * FROM {v_first}"),
    "indexable_content": (lambda t: _content(t).drop("embedding"), "SELECT * EXCLUDE (embedding) FROM {v_content}"),
    "with_current_index": (lambda t: S.with_current_index(_content(t), t["index_states"], DIMENSIONS).select("chunk_id", "document_version_id"), "SELECT chunk_id, document_version_id FROM {v_indexed}"),
    "is_org_admin": (
        lambda t: A.is_org_admin(t["users"], t["organizations"], t["user_roles"], t["roles"]),
        """SELECT u.organization_id, u.id AS user_id, u.status = 'active' AND EXISTS (SELECT 1 FROM {user_roles} ur JOIN {roles} r ON r.id = ur.role_id AND r.organization_id = ur.organization_id AND r.name = 'org_admin'
  JOIN {organizations} o ON o.id = ur.organization_id AND o.status = 'active' WHERE ur.user_id = u.id AND ur.organization_id = u.organization_id) AS is_admin FROM {users} u""",
    ),
    "owned_ids": (
        owned_ids,
        """SELECT organization_id, count(*) AS n_wanted, count(own) AS n_owned, count(*) = count(own) AS all_owned FROM (SELECT DISTINCT g.organization_id, g.knowledge_space_id + 1 AS id, s.id AS own FROM {user_grants} g LEFT JOIN {spaces} s ON s.id = g.knowledge_space_id + 1 AND s.organization_id = g.organization_id) GROUP BY 1""",
    ),
}
