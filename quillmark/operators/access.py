"""Who may read what: grants, identities, groups, source access lists.

All operators work on all users at once.  Tables carry organization_id, and every join includes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmark.functions.predicates import is_effective, is_live
from quillmark.functions.scalars import email_domain
from quillmark.operators.permissions import interned
from quillmark.storage import INNER_KEYS, OUTER_KEYS, crossed, cut, few, packed

MAX_DEPTH = 16


_GRANT = ["organization_id", "user_id", "knowledge_space_id"]


def tenant_grants(grant: DataFrame, as_of: Column) -> DataFrame:
    """(organization_id, knowledge_space_id) granted to all active users of the organization."""
    return grant.filter(is_effective("granted_at", "expires_at", "revoked_at", as_of)).select("organization_id", "knowledge_space_id").distinct()


def named_grants(users: DataFrame, grants: dict[str, DataFrame], memberships: dict[str, DataFrame], units: dict[str, DataFrame], as_of: Column, spaces: DataFrame | None = None) -> DataFrame:
    """(organization_id, user_id, knowledge_space_id) by the kinds of grant that name users or units: department, team, user.

    Parents of departments don't count, and any level of permission reads.  spaces (organization_id,
    knowledge_space_id): those that are asked for, all if it isn't given; grants of others drop out before users meet them.
    """
    people = users.filter(is_live()).select("organization_id", F.col("id").alias("user_id"))
    valid = {k: g.filter(is_effective("granted_at", "expires_at", "revoked_at", as_of)) for k, g in grants.items()}
    if spaces is not None:
        valid = {k: g.join(spaces, ["organization_id", "knowledge_space_id"], "left_semi") for k, g in valid.items()}
    paths = [valid["user"].join(people, ["organization_id", "user_id"]).select(_GRANT)]
    for kind in ("department", "team"):
        unit = f"{kind}_id"
        held = memberships[kind].filter(is_live() & is_effective("effective_from", "expires_at", "revoked_at", as_of)).select("organization_id", unit, "user_id")
        live = units[kind].filter(is_live()).select("organization_id", F.col("id").alias(unit))
        # a unit's grants of one space are one before its members meet them
        spaces = valid[kind].select("organization_id", unit, "knowledge_space_id").distinct().join(live, ["organization_id", unit])
        paths.append(spaces.join(held, ["organization_id", unit]).join(people, ["organization_id", "user_id"]).select(_GRANT))
    return union_grants(*paths)


def granted_spaces(users: DataFrame, grants: dict[str, DataFrame], memberships: dict[str, DataFrame], units: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """The same with the organization's grants given to each active user; `permissions` keeps these as flags of spaces.

    Users are classes by the units that they are held in.  A class's spaces are made distinct, and what a user is granted
    besides is held against them, before users take the place of classes, so no pair of user and space is made twice.
    """
    org, pair = ["organization_id"], ["organization_id", "knowledge_space_id"]
    people = cut(users.filter(is_live()).select("organization_id", F.col("id").alias("user_id")))
    valid = {k: g.filter(is_effective("granted_at", "expires_at", "revoked_at", as_of)) for k, g in grants.items()}
    open_ = cut(tenant_grants(grants["organization"], as_of))
    of_unit, held = [], []
    for kind in ("department", "team"):
        unit = [F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("string").alias("unit")]
        live = units[kind].filter(is_live()).select("organization_id", F.col("id").alias(f"{kind}_id"))
        of_unit.append(valid[kind].join(live, [*org, f"{kind}_id"], "left_semi").select(*org, *unit, "knowledge_space_id"))
        held.append(memberships[kind].filter(is_live() & is_effective("effective_from", "expires_at", "revoked_at", as_of)).select(*org, "user_id", *unit))
    of_unit = union_grants(*of_unit).join(open_, pair, "left_anti").select(*org, "kind", "unit", "knowledge_space_id")
    members = union_grants(*held).join(people, [*org, "user_id"], "left_semi")
    classed, units_of = interned(cut(members.select(*org, "user_id", "kind", "unit")), [*org, "user_id"], ["kind", "unit"], "unit_set")
    spaces = cut(units_of.join(of_unit, [*org, "kind", "unit"]).select(*org, "unit_set", "knowledge_space_id").distinct())
    own = valid["user"].join(people, [*org, "user_id"], "left_semi").select(_GRANT).distinct().join(open_, pair, "left_anti")
    own = own.join(classed, [*org, "user_id"], "left").join(spaces, [*org, "unit_set", "knowledge_space_id"], "left_anti").select(_GRANT)
    return own.unionByName(_all_pairs(classed, spaces, [*org, "unit_set"])).unionByName(_all_pairs(people, open_, org))


def _all_pairs(users: DataFrame, spaces: DataFrame, on: list[str]) -> DataFrame:
    of_users, of_spaces = packed(users, on, "user_id", OUTER_KEYS), packed(spaces, on, "knowledge_space_id", INNER_KEYS)
    return crossed(spaces.select(*on).distinct(), of_users, of_spaces, on, on, "user_id", "knowledge_space_id").select(_GRANT)


def union_grants(*paths: DataFrame) -> DataFrame:
    """All rows of the paths, each once."""
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.distinct()


def verified_identities(users: DataFrame, links: DataFrame, principals: DataFrame) -> DataFrame:
    people = users.filter(is_live()).select("organization_id", F.col("id").alias("user_id"))
    held = links.filter((F.col("status") == "verified") & F.col("verified_at").isNotNull() & F.col("revoked_at").isNull())
    own = principals.filter((F.col("principal_type") == "user") & is_live("lifecycle")).select("organization_id", "connector_id", F.col("id").alias("external_principal_id"), "normalized_email")
    joined = held.join(people, ["organization_id", "user_id"]).join(own, ["organization_id", "connector_id", "external_principal_id"])
    return joined.select("organization_id", "user_id", "connector_id", F.col("external_principal_id").alias("principal_id"), "normalized_email")


def usable_directories(states: DataFrame) -> DataFrame:
    good = (F.col("current_generation") > 0) & F.col("last_successful_at").isNotNull() & F.col("status").isin("complete", "syncing", "stale", "failed")
    return states.filter(good).select("organization_id", "connector_id", "current_generation")


def edges_at_generation(edges: DataFrame, directories: DataFrame) -> DataFrame:
    """The live edges whose range of generations holds the directory's current one."""
    at = (F.col("first_seen_generation") <= F.col("current_generation")) & (F.col("last_seen_generation") >= F.col("current_generation"))
    live = edges.filter(is_live("lifecycle", "removed_at"))
    return live.join(directories, ["organization_id", "connector_id"]).filter(at).select("organization_id", "connector_id", "group_principal_id", "member_principal_id")


def group_ancestors(step: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(organization_id, connector_id, group_principal_id, ancestor_id, distance): the groups above each group.

    step: organization_id, connector_id, member_principal_id, group_principal_id.  A level is a join of the
    pairs found last; pairs known before are dropped, so cycles end and a group reached in many ways counts once.
    """
    at = ["organization_id", "connector_id"]
    named = step.select(*at, F.col("group_principal_id").alias("member_principal_id")).distinct()
    up = few(step.join(named, [*at, "member_principal_id"], "left_semi"))
    pair = [*at, "group_principal_id", "ancestor_id"]
    last = cut(up.select(*at, F.col("member_principal_id").alias("group_principal_id"), F.col("group_principal_id").alias("ancestor_id")).distinct().withColumn("distance", F.lit(1)))
    known = last
    for d in range(2, depth):
        above = up.select(*at, F.col("member_principal_id").alias("ancestor_id"), F.col("group_principal_id").alias("_above"))
        found = last.join(above, [*at, "ancestor_id"]).select(*at, "group_principal_id", F.col("_above").alias("ancestor_id")).distinct()
        last = cut(found.join(known, pair, "left_anti").withColumn("distance", F.lit(d)))
        if last.isEmpty():
            break
        known = cut(known.unionByName(last))
    return known


def group_closure(identities: DataFrame, edges: DataFrame, principals: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(organization_id, user_id, connector_id, principal_id, depth): the groups that a user reaches, at the least depth.

    Groups are closed once, whatever the number of users; users then take what is above their own groups.
    """
    at = ["organization_id", "connector_id"]
    groups = principals.filter((F.col("principal_type") == "group") & is_live("lifecycle")).select(*at, F.col("id").alias("group_principal_id"))
    step = cut(edges.join(groups, [*at, "group_principal_id"]).select(*at, "member_principal_id", "group_principal_id").distinct())
    own = identities.select("organization_id", "user_id", "connector_id", F.col("principal_id").alias("member_principal_id"))
    direct = own.join(step, [*at, "member_principal_id"]).select("organization_id", "user_id", "connector_id", "group_principal_id").distinct()
    higher = direct.join(few(group_ancestors(step, depth)), [*at, "group_principal_id"])
    walk = direct.select("organization_id", "user_id", "connector_id", F.col("group_principal_id").alias("principal_id"), F.lit(1).alias("depth")).unionByName(higher.select("organization_id", "user_id", "connector_id", F.col("ancestor_id").alias("principal_id"), (F.col("distance") + 1).alias("depth")))
    return walk.groupBy("organization_id", "user_id", "connector_id", "principal_id").agg(F.min("depth").alias("depth"))


def domain_principals(identities: DataFrame, principals: DataFrame) -> DataFrame:
    domains = principals.filter((F.col("principal_type") == "domain") & is_live("lifecycle") & (F.btrim("normalized_domain") != "")).select("organization_id", "connector_id", F.col("normalized_domain").alias("domain"), F.col("id").alias("domain_id"))
    mail = identities.withColumn("domain", email_domain(F.col("normalized_email")))
    return mail.join(domains, ["organization_id", "connector_id", "domain"]).select("organization_id", "user_id", "connector_id", F.col("domain_id").alias("principal_id"))


def everyone_principals(principals: DataFrame) -> DataFrame:
    """(organization_id, connector_id, principal_id) that every active user of the tenant is; no identity is needed."""
    return principals.filter((F.col("principal_type") == "anyone") & is_live("lifecycle")).select("organization_id", "connector_id", F.col("id").alias("principal_id"))


def anyone_principals(users: DataFrame, principals: DataFrame) -> DataFrame:
    """Everyone in the tenant is `anyone`: a row for each user, as a list for people; access is judged by the flag."""
    people = users.filter(is_live()).select("organization_id", F.col("id").alias("user_id"))
    return everyone_principals(principals).join(people, "organization_id")


def named_principals(users: DataFrame, links: DataFrame, principals: DataFrame, directories: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(organization_id, user_id, connector_id, principal_id): all that a user counts as, without `anyone`."""
    keys = ["organization_id", "user_id", "connector_id", "principal_id"]
    own = verified_identities(users, links, principals)
    groups = group_closure(own, edges_at_generation(edges, usable_directories(directories)), principals, depth)
    return union_principals(own.select(keys), groups.select(keys), domain_principals(own, principals).select(keys))


def resolved_principals(users: DataFrame, links: DataFrame, principals: DataFrame, directories: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """The same with `anyone` of each user's tenant; these are of another type than all others, so no row comes twice."""
    keys = ["organization_id", "user_id", "connector_id", "principal_id"]
    return named_principals(users, links, principals, directories, edges, depth).unionByName(anyone_principals(users, principals).select(keys))


union_principals = union_grants


def scope_paths(memberships: DataFrame, scopes: DataFrame, connectors: DataFrame, spaces: DataFrame, items: DataFrame) -> DataFrame:
    """How items can be reached: (organization_id, source_item_id, connector_scope_id, knowledge_space_id, connector_id, access_mode), all parts live."""
    named = lambda df, name, *more: df.select("organization_id", F.col("id").alias(name), *more)
    live_scopes = named(scopes.filter(is_live()), "connector_scope_id", "connector_id", "knowledge_space_id", "access_mode")
    ways = live_scopes.join(named(connectors.filter(is_live()), "connector_id"), ["organization_id", "connector_id"]).join(named(spaces.filter(is_live()), "knowledge_space_id"), ["organization_id", "knowledge_space_id"])
    live_items = named(items.filter(is_live(gone="deleted_at")), "source_item_id", "connector_id", "source_item_type")
    held = memberships.filter(is_live(gone="removed_at")).select("organization_id", "connector_id", "source_item_id", "connector_scope_id")
    out = held.join(ways, ["organization_id", "connector_id", "connector_scope_id"]).join(live_items, ["organization_id", "connector_id", "source_item_id"])
    return out.select("organization_id", "source_item_id", "connector_scope_id", "knowledge_space_id", "connector_id", "access_mode", "source_item_type")


eligible_scope_paths = scope_paths


def authorized_paths(paths: DataFrame, granted: DataFrame, allowed: DataFrame, denied: DataFrame) -> DataFrame:
    """paths with user_id, where the path's access mode lets the user read, of pairs of users and items.

    For a few users, as in a check of one; `permissions.class_access` judges all of them by classes.
    """
    by_grant = paths.join(granted, ["organization_id", "knowledge_space_id"])
    item = ["organization_id", "connector_id", "source_item_id", "user_id"]
    listed = allowed.join(denied, item, "left_anti")
    platform = by_grant.filter("access_mode = 'platform_managed'")
    source = paths.filter("access_mode = 'source_acl'").join(listed, item[:3])
    hybrid = by_grant.filter("access_mode = 'hybrid'").join(listed, item, "left_semi")
    return platform.unionByName(source).unionByName(hybrid)


def first_path_per_item(paths: DataFrame) -> DataFrame:
    """Of each user's paths to an item the one with the least scope id."""
    best = F.row_number().over(Window.partitionBy("organization_id", "user_id", "source_item_id").orderBy("connector_scope_id"))
    return paths.withColumn("_n", best).filter("_n = 1").drop("_n")


def is_org_admin(users: DataFrame, organizations: DataFrame, user_roles: DataFrame, roles: DataFrame, role: str = "org_admin") -> DataFrame:
    """(organization_id, user_id, is_admin) of every user."""
    live = organizations.filter(is_live()).select(F.col("id").alias("organization_id"))
    named = roles.filter(F.col("name") == role).select("organization_id", F.col("id").alias("role_id"))
    holders = user_roles.join(named, ["organization_id", "role_id"]).join(live, "organization_id").select("organization_id", "user_id", F.lit(True).alias("_held")).distinct()
    people = users.select("organization_id", F.col("id").alias("user_id"), is_live().alias("_live"))
    return people.join(holders, ["organization_id", "user_id"], "left").select("organization_id", "user_id", (F.col("_live") & F.coalesce("_held", F.lit(False))).alias("is_admin"))


def owned_ids(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(organization_id, n_wanted, n_owned, all_owned): whether each tenant owns all ids it asks for.  wanted: organization_id, id."""
    own = df.select("organization_id", "id", F.lit(1).alias("_own")).distinct()
    return wanted.distinct().join(own, ["organization_id", "id"], "left").groupBy("organization_id").agg(F.count("*").alias("n_wanted"), F.count("_own").alias("n_owned")).withColumn("all_owned", F.col("n_wanted") == F.col("n_owned"))


def ids_owned_by(df: DataFrame, organization_id, ids: list) -> bool:
    return df.filter((F.col("organization_id") == organization_id) & F.col("id").isin(ids)).select("id").distinct().count() == len(set(ids))
