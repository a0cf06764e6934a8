"""Catalogue changes: what a crawl found against what is known, and the tables that follow.

Each operator takes whole tables and gives the next table.  Spark can't merge into Parquet, so a table
is replaced by what the operator returns.  Every time is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmark.functions.scalars import json_field, matches, numeric_id, row_id
from quillmark.sources.snapshots import BUCKETS, Catalogue, upsert_snapshot  # noqa: F401

ITEM = ["organization_id", "connector_id", "source_item_key"]


def diff_catalog(manifest: DataFrame, catalog: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    """All keys of both sides with `seen` and `known`."""
    return manifest.select(*keys).distinct().withColumn("seen", F.lit(True)).join(catalog.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "full_outer").fillna(False, ["seen", "known"])


def _like(rows: DataFrame, table: DataFrame, **values: Column) -> DataFrame:
    """rows with the columns of table, in its order and types: those given, else its own, else null."""
    kind = {f.name: f.dataType for f in table.schema}
    of = lambda c: values[c] if c in values else F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(*[of(c).cast(kind[c]).alias(c) for c in table.columns])


def item_state(items: DataFrame, versions: DataFrame, states: DataFrame, profile: str | None = None, run_items: DataFrame | None = None) -> DataFrame:
    """Each item with its current version, that version's index state (under the profile, if one is named), and what the
    run has done with it: run_items has organization_id, source_item_id, status, current_checksum."""
    current = versions.filter("is_current").select("organization_id", "source_item_id", F.col("id").alias("document_version_id"), "content_checksum", "version_number", "lifecycle")
    kept = states if profile is None else states.filter(F.col("profile_fingerprint") == profile)
    index = kept.select("organization_id", "document_version_id", F.col("status").alias("index_status"), "indexed_generation", "desired_generation")
    named = items.select("organization_id", "connector_id", F.col("id").alias("source_item_id"), "source_item_key", "source_checksum", F.col("status").alias("item_status"))
    out = named.join(current, ["organization_id", "source_item_id"], "left").join(index, ["organization_id", "document_version_id"], "left")
    if run_items is None:
        return out
    done = run_items.select("organization_id", "source_item_id", F.col("status").alias("run_item_status"), F.col("current_checksum").alias("run_item_checksum"))
    return out.join(done, ["organization_id", "source_item_id"], "left")


def classify_changes(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """(keys, change_type, outcome) of every key of the manifest and the catalogue.

    A file is unchanged if item, version and manifest agree on its checksum and it is indexed at the
    generation asked for.  Unsupported files count as changed each time.  Where the state tells what this run has
    done, a file that it finished with this checksum is already complete.
    """
    new = manifest.select(*ITEM, F.col("source_checksum").alias("_sum"), "unsupported", F.lit(True).alias("_seen"))
    joined = new.join(state.withColumn("_known", F.lit(True)), ITEM, "full_outer")
    same = (F.col("source_checksum") == F.col("_sum")) & (F.col("content_checksum") == F.col("_sum"))
    indexed = (F.col("index_status") == "indexed") & (F.col("indexed_generation") == F.col("desired_generation"))
    kind = F.when(F.col("_seen").isNull(), "deleted").when(F.col("_known").isNull(), "new").when(F.coalesce(F.col("unsupported"), F.lit(False)), "changed").when(F.coalesce(same & indexed & (F.col("item_status") == "active"), F.lit(False)), "unchanged").otherwise("changed")
    done = F.lit(False)
    if "run_item_status" in state.columns:
        done = F.coalesce(F.col("run_item_status").isin("succeeded", "skipped") & (F.col("run_item_checksum") == F.col("_sum")), F.lit(False))
    outcome = F.when(F.col("change_type") == "deleted", "retired").when(F.col("unsupported"), "unsupported").when(done, "already_complete").when(F.col("change_type") == "unchanged", "unchanged").otherwise("indexed")
    return joined.withColumn("change_type", kind).withColumn("outcome", outcome).select(*ITEM, "change_type", "outcome")


#: Stands for the checksum of what can't be unchanged, and differs on the two sides.
_STALE, _UNSUPPORTED = "stale", "unsupported"


def _indexed_checksum(state: DataFrame) -> Column:
    """The checksum under which a seen file counts as unchanged, or a mark if there is none."""
    good = (F.col("source_checksum") == F.col("content_checksum")) & (F.col("index_status") == "indexed") & (F.col("indexed_generation") == F.col("desired_generation")) & (F.col("item_status") == "active")
    return F.when(F.coalesce(good, F.lit(False)), F.concat(F.lit("="), F.col("source_checksum"))).otherwise(F.lit(_STALE))


def keep_state(catalogue: Catalogue, state: DataFrame, name: str = "item_state", buckets: int = BUCKETS) -> int:
    """Commit what `item_state` gives, with digests of keys and the checksums under which they are unchanged."""
    return catalogue.replace(name, state.withColumn("_indexed", _indexed_checksum(state)), ITEM, ["_indexed"], buckets)


def classify_by_digests(catalogue: Catalogue, manifest: DataFrame, name: str = "item_state") -> tuple[DataFrame, DataFrame]:
    """(what `classify_changes` gives, the part of the kept state that was read for it).

    Where the digests of a part of the keys agree, its files are all unchanged, and the state isn't read there.
    """
    mark = F.when(F.coalesce(F.col("unsupported"), F.lit(False)), F.lit(_UNSUPPORTED)).otherwise(F.concat(F.lit("="), F.coalesce("source_checksum", F.lit("\0"))))
    same, differ, known = catalogue.changed(name, manifest.select(*ITEM, "source_checksum", "unsupported", mark.alias("_indexed")))
    unchanged = same.select(*ITEM, F.lit("unchanged").alias("change_type"), F.lit("unchanged").alias("outcome"))
    return classify_changes(differ, known).unionByName(unchanged), known


def upsert_items(manifest: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Items after a crawl, with items' columns and `restored`: seen ones are active as of now, with what the manifest says
    of them; new ones have an id made of their key and are first seen now; others stay."""
    told = [c for c in manifest.columns if c in items.columns and c not in ITEM]
    new = manifest.select(*ITEM, *[F.col(c).alias(f"_{c}") for c in told], F.lit(True).alias("_seen"))
    joined = items.join(new, ITEM, "full_outer")
    seen, known = F.col("_seen").isNotNull(), F.col("first_seen_at").isNotNull()
    values = {c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)) for c in told}
    values |= {"id": F.coalesce("id", numeric_id(*map(F.col, ITEM))), "first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")), "status": F.when(seen, "active").otherwise(F.col("status")), "deleted_at": F.when(~seen, F.col("deleted_at"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in items.columns], (seen & known & (F.col("status") != "active")).alias("restored"))


def _once(rows: DataFrame, keys: list[str], told: list[str]) -> DataFrame:
    """The rows' keys, each once, with the columns told as _name and _seen; of equal keys the greatest values."""
    if not told:
        return rows.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return rows.groupBy(*keys).agg(F.max(F.struct(*told)).alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(f"_{c}") for c in told], F.lit(True).alias("_seen"))


def upsert_memberships(seen: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """The next memberships after a crawl, with all columns: seen ones are live as of now, new ones have an id made of their key.

    seen: organization_id, source_item_id, connector_scope_id, and what else memberships have, connector_id above all,
    which new ones take and known ones keep."""
    keys = ["organization_id", "source_item_id", "connector_scope_id"]
    told = [c for c in seen.columns if c in memberships.columns and c not in keys]
    joined = memberships.join(_once(seen, keys, told), keys, "full_outer")
    hit = F.col("_seen").isNotNull()
    values = {c: F.coalesce(c, f"_{c}") for c in told}
    values |= {"id": F.coalesce("id", numeric_id(*map(F.col, keys)))} if "id" in memberships.columns else {}
    values |= {"status": F.when(hit, "active").otherwise(F.col("status")), "removed_at": F.when(~hit, F.col("removed_at")), "first_discovered_at": F.coalesce("first_discovered_at", now), "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at"))}
    return _like(joined, memberships, **values)


def items_in_scope(items: DataFrame, memberships: DataFrame, scope_id: str | None = None) -> DataFrame:
    held = memberships if scope_id is None else memberships.filter(F.col("connector_scope_id") == scope_id)
    return items.join(held.select("organization_id", F.col("source_item_id").alias("id")), ["organization_id", "id"], "left_semi")


def without_active_membership(items: DataFrame, memberships: DataFrame) -> DataFrame:
    live = memberships.filter("status = 'active' and removed_at is null").select("organization_id", F.col("source_item_id").alias("id"))
    return items.join(live, ["organization_id", "id"], "left_anti")


def retire_missing_folder(memberships: DataFrame, items: DataFrame, run_started: Column, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memberships, items, run items) after a folder crawl: what it didn't see is removed; items that no live
    membership holds any more become unavailable, and their documents stay.  Each removed membership is a deleted run item."""
    stale = (F.col("status") == "active") & F.col("removed_at").isNull() & (F.col("last_seen_at") < run_started)
    left = memberships.withColumn("_stale", stale).withColumn("status", F.when(F.col("_stale"), "removed").otherwise(F.col("status"))).withColumn("removed_at", F.when(F.col("_stale"), now).otherwise(F.col("removed_at")))
    touched = left.filter("_stale").select("organization_id", F.col("source_item_id").alias("id")).distinct()
    lost = without_active_membership(touched, left).withColumn("_lost", F.lit(True))
    after = items.join(lost, ["organization_id", "id"], "left").withColumn("status", F.when(F.col("_lost"), "unavailable").otherwise(F.col("status"))).drop("_lost")
    run = left.filter("_stale").select("organization_id", "source_item_id", "connector_scope_id", F.lit("deleted").alias("change_type"), F.lit("succeeded").alias("status"))
    return left.drop("_stale"), after, run


def unseen_candidates(memberships: DataFrame, items: DataFrame, versions: DataFrame, mappings: DataFrame, documents: DataFrame, run_started: Column) -> DataFrame:
    """Live memberships that the run didn't see, of items with a current available version and a live document."""
    stale = memberships.filter((F.col("status") == "active") & F.col("removed_at").isNull() & (F.col("last_seen_at") < run_started)).select("organization_id", "source_item_id", "connector_scope_id")
    current = versions.filter("is_current and lifecycle = 'available'").select("organization_id", "source_item_id", F.col("id").alias("document_version_id"), "version_number")
    live = documents.filter("deleted_at is null").select("organization_id", F.col("id").alias("document_id"))
    held = items.filter("status = 'active'").select("organization_id", F.col("id").alias("source_item_id"))
    return stale.join(held, ["organization_id", "source_item_id"]).join(current, ["organization_id", "source_item_id"]).join(mappings.select("organization_id", "document_version_id", "document_id"), ["organization_id", "document_version_id"]).join(live, ["organization_id", "document_id"])


def repo_retirements(candidates: DataFrame, memberships: DataFrame) -> DataFrame:
    """What a finished repository crawl retires: each candidate, whether no live membership holds the item
    any more, and the number of the tombstone version that follows if so."""
    stale = candidates.select("organization_id", "source_item_id", "connector_scope_id")
    rest = memberships.filter("status = 'active' and removed_at is null").join(stale, stale.columns, "left_anti").select("organization_id", "source_item_id").distinct().withColumn("_other", F.lit(True))
    last = F.col("_other").isNull()
    return candidates.join(rest, ["organization_id", "source_item_id"], "left").select("organization_id", "source_item_id", "connector_scope_id", "document_id", last.alias("deletes_item"), F.when(last, F.col("version_number") + 1).alias("tombstone_version"))


def retire_missing_repo(candidates: DataFrame, memberships: DataFrame, items: DataFrame, versions: DataFrame, documents: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The next memberships, items, versions, documents, and the run items, after a finished repository crawl.

    Candidates' memberships are removed.  An item that no live membership holds then is deleted, with a
    tombstone version as its current one, and its document is deleted softly."""
    plan = repo_retirements(candidates, memberships)
    item = ["organization_id", "source_item_id"]
    gone = plan.filter("deletes_item").select(*item, "document_id").distinct()
    away = plan.select(*item, "connector_scope_id").distinct().withColumn("_away", F.lit(True))
    hit = F.col("_away").isNotNull()
    held = memberships.join(away, [*item, "connector_scope_id"], "left")
    lost = gone.select("organization_id", F.col("source_item_id").alias("id")).distinct().withColumn("_away", F.lit(True))
    current = versions.filter("is_current").select(*item, "provider_version_id")
    reason = F.to_json(F.struct(F.lit("provider_deleted").alias("reason")))
    tombs = gone.select(*item).distinct().join(current, item, "left").select(*item, "provider_version_id", F.lit("tombstone").alias("version_cause"), F.lit("deleted").alias("lifecycle"), reason.alias("version_metadata"))
    known = items.select("organization_id", F.col("id").alias("source_item_id"), "source_checksum")
    return {
        "memberships": _like(held, memberships, status=F.when(hit, "removed").otherwise(F.col("status")), removed_at=F.when(hit, now).otherwise(F.col("removed_at"))),
        "items": _like(items.join(lost, ["organization_id", "id"], "left"), items, status=F.when(hit, "deleted").otherwise(F.col("status")), deleted_at=F.when(hit, now).otherwise(F.col("deleted_at"))),
        "versions": append_versions(tombs, versions, now),
        "documents": soft_delete(documents, gone, now),
        "run_items": plan.select(*item, "connector_scope_id").join(known, item, "left").select(*item, "connector_scope_id", F.lit("deleted").alias("change_type"), F.lit("succeeded").alias("status"), F.col("source_checksum").alias("previous_checksum")),
    }


def soft_delete(documents: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """documents with those of gone (organization_id, document_id) deleted as of now, if they weren't before."""
    hit = gone.select("organization_id", F.col("document_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return _like(documents.join(hit, ["organization_id", "id"], "left"), documents, deleted_at=F.when(F.col("_gone").isNotNull(), F.coalesce(F.col("deleted_at"), now)).otherwise(F.col("deleted_at")))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("organization_id", "source_item_id").agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"))


def append_versions(changes: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """versions with one more for each change; the newest of an item is its current one.

    changes: organization_id, source_item_id, version_cause, lifecycle, and whatever else versions have.  Changes of one
    item are numbered by `change_order` if they have it, else by checksum; ids are made of item and number."""
    item = ["organization_id", "source_item_id"]
    order = [c for c in ("change_order", "content_checksum", "version_cause") if c in changes.columns]
    nth = F.row_number().over(Window.partitionBy(*item).orderBy(*order))
    more = changes.withColumn("_nth", nth).join(next_version(versions), item, "left").withColumn("version_number", (F.coalesce("next_version", F.lit(1)) + F.col("_nth") - 1).cast("long"))
    new = _like(more, versions, id=numeric_id(F.col("source_item_id"), F.col("version_number")), discovered_at=now)
    return mark_current(versions.unionByName(new)).select(*versions.columns)


def mark_current(versions: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("organization_id", "source_item_id").orderBy(F.desc("version_number")))
    return versions.withColumn("is_current", newest == 1)


def needs_tombstone(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """The changes whose item has no current version, or one that isn't unavailable, or of another blob or reason.

    changes: organization_id, source_item_id, provider_version_id, reason."""
    now_ = versions.filter("is_current").select("organization_id", "source_item_id", F.col("provider_version_id").alias("_blob"), F.col("lifecycle").alias("_life"), json_field(F.col("version_metadata"), "reason").alias("_reason"))
    same = (F.col("_life") == "unavailable") & F.col("_blob").eqNullSafe(F.col("provider_version_id")) & F.col("_reason").eqNullSafe(F.col("reason"))
    return changes.join(now_, ["organization_id", "source_item_id"], "left").filter(~F.coalesce(same, F.lit(False))).select(*changes.columns)


def tombstone_unindexable(changes: DataFrame, versions: DataFrame, mappings: DataFrame, documents: DataFrame, items: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The next versions, documents and items, and the errors, after changes that can't be indexed.

    Items become unavailable and the documents of their current versions are deleted softly; a tombstone is
    appended where blob or reason are new."""
    item = ["organization_id", "source_item_id"]
    reason = F.to_json(F.struct("reason"))
    tombs = needs_tombstone(changes, versions).select(*item, "provider_version_id", F.lit("tombstone").alias("version_cause"), F.lit("unavailable").alias("lifecycle"), reason.alias("version_metadata"))
    gone = current_materialization(versions, mappings).join(changes.select(*item).distinct(), item, "left_semi")
    hit = changes.select("organization_id", F.col("source_item_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    errors = changes.select(*item, F.lit("extraction").alias("category"), F.col("reason").alias("code"), F.lit("the content can't be indexed").alias("message"), F.lit(False).alias("retryable"), F.lit(1).alias("attempt"), now.alias("occurred_at"))
    return {
        "versions": append_versions(tombs, versions, now),
        "documents": soft_delete(documents, gone, now),
        "items": _like(items.join(hit, ["organization_id", "id"], "left"), items, status=F.when(F.col("_hit").isNotNull(), "unavailable").otherwise(F.col("status"))),
        "errors": errors,
    }


def remap_materialization(new: DataFrame, mappings: DataFrame, versions: DataFrame) -> DataFrame:
    """mappings with the new ones, without old ones that share a version, a document or the version's item with them."""
    at = ["organization_id", "document_version_id"]
    item_of = versions.select("organization_id", F.col("id").alias("document_version_id"), "source_item_id")
    items = new.join(item_of, at).select("organization_id", "source_item_id").distinct()
    of_item = item_of.join(items, ["organization_id", "source_item_id"], "left_semi").select(at)
    left = mappings.join(new.select(at).unionByName(of_item).distinct(), at, "left_anti").join(new.select("organization_id", "document_id").distinct(), ["organization_id", "document_id"], "left_anti")
    return left.select(*mappings.columns).unionByName(new.select(*mappings.columns))


def current_materialization(versions: DataFrame, mappings: DataFrame) -> DataFrame:
    current = versions.filter("is_current").select("organization_id", "source_item_id", F.col("id").alias("document_version_id"))
    return current.join(mappings, ["organization_id", "document_version_id"]).select("organization_id", "source_item_id", "document_version_id", "document_id")


def upsert_documents(incoming: DataFrame, documents: DataFrame, now: Column, revive: bool = True) -> DataFrame:
    """Documents after ingestion, with documents' columns and `outcome`: created, updated, restored, unchanged, or null if
    not met.  New ones have an id made of their key.

    incoming: organization_id, source_type, source_document_key, and what is to be replaced, title and
    checksum_latest at least.  Folder crawls leave deleted documents deleted (revive=False)."""
    keys = ["organization_id", "source_type", "source_document_key"]
    told = [c for c in incoming.columns if c in documents.columns and c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in told], F.lit(True).alias("_seen"))
    joined = documents.withColumn("_known", F.lit(True)).join(new, keys, "full_outer")
    seen, known, gone = F.col("_seen").isNotNull(), F.col("_known").isNotNull(), F.col("deleted_at").isNotNull()
    outcome = F.when(~seen, None).when(~known, "created").when(gone & F.lit(revive), "restored").when(F.col("checksum_latest").eqNullSafe(F.col("_checksum_latest")), "unchanged").otherwise("updated")
    values = {c: F.coalesce(f"_{c}", c) for c in told}
    values |= {"id": F.coalesce("id", numeric_id(*map(F.col, keys))), "status": F.when(seen, "ready").otherwise(F.col("status")), "deleted_at": F.when(~seen, F.col("deleted_at")) if revive else F.col("deleted_at"), "created_at": F.coalesce("created_at", now)}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in documents.columns], outcome.alias("outcome"))


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of a document that has new ones are replaced together."""
    touched = new.select("organization_id", "document_id").distinct()
    return existing.join(touched, ["organization_id", "document_id"], "left_anti").unionByName(new.select(*existing.columns))


def ensure_index_state(versions: DataFrame, states: DataFrame, profile: str, model: str, dimensions: int, reason: str = "new_version") -> DataFrame:
    """The next states, with all columns: current versions without one under the profile have a pending one, whose id is made of both."""
    have = states.filter(F.col("profile_fingerprint") == profile).select("organization_id", "document_version_id")
    need = versions.filter("is_current").select("organization_id", F.col("id").alias("document_version_id")).join(have, ["organization_id", "document_version_id"], "left_anti")
    values = {"id": numeric_id(F.col("document_version_id"), F.lit(profile)), "profile_fingerprint": F.lit(profile), "embedding_model": F.lit(model), "embedding_dimensions": F.lit(dimensions), "reason": F.lit(reason)}
    values |= {"desired_generation": F.lit(1), "indexed_generation": F.lit(0), "status": F.lit("pending"), "attempt_count": F.lit(0)}
    return states.unionByName(_like(need, states, **values))


def advance_index_state(states: DataFrame, requests: DataFrame) -> DataFrame:
    """states after requests (id, generation): a generation that rises asks for new work; others are ignored."""
    want = requests.groupBy("id").agg(F.max("generation").alias("_want"))
    joined = states.join(want, "id", "left")
    up = F.coalesce(F.col("_want") > F.col("desired_generation"), F.lit(False))
    return joined.select(*[c for c in states.columns if c not in ("desired_generation", "status", "attempt_count", "next_retry_at")], F.when(up, F.col("_want")).otherwise(F.col("desired_generation")).alias("desired_generation"), F.when(up, "pending").otherwise(F.col("status")).alias("status"), F.when(up, 0).otherwise(F.col("attempt_count")).alias("attempt_count"), F.when(~up, F.col("next_retry_at")).alias("next_retry_at"))


def start_attempts(states: DataFrame, attempts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, attempts) after attempts begin: states are processing with one attempt more, attempts have their next number.

    requests: id (of the state), trigger_type, started_at; one for each state."""
    asked = requests.select("id", F.col("trigger_type").alias("_trigger"), F.col("started_at").alias("_start"))
    joined = states.join(asked, "id", "left")
    hit = F.col("_trigger").isNotNull()
    values = {"attempt_count": F.col("attempt_count") + hit.cast("int"), "status": F.when(hit, "processing").otherwise(F.col("status")), "next_retry_at": F.when(~hit, F.col("next_retry_at"))}
    after = joined.select(*[values.get(c, F.col(c)).alias(c) for c in states.columns])
    last = attempts.groupBy(F.col("indexing_state_id").alias("id")).agg(F.max("attempt_number").alias("_last"))
    begun = asked.join(states.select("id"), "id", "left_semi").join(last, "id", "left").withColumn("_n", F.coalesce("_last", F.lit(0)) + 1)
    new = _like(begun, attempts, id=numeric_id(F.col("id"), F.col("_n")), indexing_state_id=F.col("id"), attempt_number=F.col("_n"), trigger_type=F.col("_trigger"), status=F.lit("running"), started_at=F.col("_start"))
    return after, attempts.unionByName(new)


def complete_attempts(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """attempts after results, and `rejected`, why a result of an attempt wasn't taken.

    results: id, status, completed_at, error_category, error_code.  Only a running attempt ends, not before
    it began; it has an error if and only if it failed (a cancelled one may have one)."""
    told = results.select("id", *[F.col(c).alias(f"_{c}") for c in ("status", "completed_at", "error_category", "error_code")])
    joined = attempts.join(told, "id", "left")
    met, error = F.col("_status").isNotNull(), F.col("_error_category").isNotNull()
    reason = (
        F.when(~met, None)
        .when(F.col("status") != "running", "not_running")
        .when(~F.col("_status").isin("succeeded", "failed", "cancelled"), "unknown_status")
        .when(F.col("_completed_at") < F.col("started_at"), "before_start")
        .when(error != F.col("_error_code").isNotNull(), "half_an_error")
        .when((F.col("_status") == "succeeded") & error, "error_of_success")
        .when((F.col("_status") == "failed") & ~error, "failure_without_error")
    )
    taken = met & reason.isNull()
    return joined.select(*[F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in attempts.columns], reason.alias("rejected"))


def mark_indexed(states: DataFrame, finished: DataFrame) -> DataFrame:
    """states with the finished ids indexed at the generation asked for."""
    done = finished.select("id").distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    return states.join(done, "id", "left").withColumn("indexed_generation", F.when(hit, F.col("desired_generation")).otherwise(F.col("indexed_generation"))).withColumn("status", F.when(hit, "indexed").otherwise(F.col("status"))).drop("_done")


# Kinds of errors.
ERROR_CATEGORIES = ("configuration", "authentication", "authorization", "rate_limit", "source_read", "extraction", "persistence", "embedding", "permission", "internal")


def log_errors(failures: DataFrame) -> DataFrame:
    """failures (message, category, code) with `accepted`: messages of at most 1000 characters and 3 line ends, without a
    traceback, of a known category and with a code of the right form.  Accepted ones go to `append_history`."""
    m = F.col("message")
    good = (F.char_length(m) <= 1000) & (F.char_length(m) - F.char_length(F.replace(m, F.lit("\n"), F.lit(""))) <= 3) & ~F.contains(m, F.lit("Traceback (most recent call last)")) & (F.btrim(m) != "")
    good &= F.col("category").isin(*ERROR_CATEGORIES) & matches(F.col("code"), "code")
    return failures.withColumn("accepted", F.coalesce(good, F.lit(False)))


def upsert_scopes(incoming: DataFrame, scopes: DataFrame, now: Column | None = None) -> DataFrame:
    """The next scopes after a selection, with all columns and `outcome`: created, kept, restored, removed (no longer chosen),
    conflict (chosen in another space: the scope stays as it is), or untouched.

    incoming: organization_id, connector_id, external_scope_key, knowledge_space_id, and what else scopes have, which created
    ones take, and kept and restored ones where it isn't null.  Ids are made of the key.  Connectors that incoming doesn't
    name are untouched.  `removed_at`, where scopes have it, is set to now or cleared."""
    keys = ["organization_id", "connector_id", "external_scope_key"]
    told = [c for c in incoming.columns if c in scopes.columns and c not in keys]
    touched = incoming.select("organization_id", "connector_id").distinct().withColumn("_touched", F.lit(True))
    joined = scopes.withColumn("_known", F.lit(True)).join(_once(incoming, keys, told), keys, "full_outer").join(touched, ["organization_id", "connector_id"], "left")
    gone = F.when(F.col("_touched").isNotNull() & (F.col("status") == "active"), "removed").otherwise("untouched")
    moved = F.col("_knowledge_space_id") != F.col("knowledge_space_id")
    outcome = F.when(F.col("_known").isNull(), "created").when(F.col("_seen").isNull(), gone).when(moved, "conflict").when(F.col("status") != "active", "restored").otherwise("kept")
    joined = joined.withColumn("outcome", outcome)
    taken, removed = F.col("outcome").isin("created", "restored", "kept"), F.col("outcome") == "removed"
    values = {c: F.when(taken, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in told}
    if "id" in scopes.columns:
        made = row_id if scopes.schema["id"].dataType.simpleString() == "string" else numeric_id
        values["id"] = F.coalesce("id", made(*map(F.col, keys)))
    values["status"] = F.when(taken, "active").when(removed, "removed").otherwise(F.col("status"))
    if "removed_at" in scopes.columns:
        values["removed_at"] = F.when(removed, now if now is not None else F.col("removed_at")).when(~taken, F.col("removed_at"))
    return _like(joined, scopes.withColumn("outcome", F.lit("")), **values)


STATUS_TIMES = {"archived": "archived_at", "removed": "removed_at", "deleted": "deleted_at"}


def set_status(df: DataFrame, status: str, at: Column) -> DataFrame:
    """df with the status, and its time column set if the status has one and else cleared."""
    out = df.withColumn("status", F.lit(status))
    for name, column in STATUS_TIMES.items():
        if column in df.columns:
            out = out.withColumn(column, F.coalesce(F.col(column), at) if name == status else F.lit(None).cast(df.schema[column].dataType))
    return out


_SCHEDULE_HISTORY = ("pause_reason_code", "paused_at", "last_due_at", "last_enqueued_at", "last_job_id")


def upsert_schedules(requests: DataFrame, schedules: DataFrame) -> DataFrame:
    """One schedule for each scope: a request replaces it and resets its history.

    requests: connector_scope_id, interval_seconds, next_run_at, and for new scopes what else schedules have."""
    told = [c for c in requests.columns if c in schedules.columns and c != "connector_scope_id"]
    new = requests.select("connector_scope_id", *[F.col(c).alias(f"_{c}") for c in told], F.lit(True).alias("_seen"))
    hit = F.col("_seen").isNotNull()
    values = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in told} | {"status": F.when(hit, "active").otherwise(F.col("status"))}
    values |= {c: F.when(~hit, F.col(c)) for c in _SCHEDULE_HISTORY}
    return schedules.join(new, "connector_scope_id", "full_outer").select(*[values.get(c, F.col(c)).alias(c) for c in schedules.columns])


def _met(schedules: DataFrame, told: DataFrame) -> tuple[DataFrame, Column]:
    new = told.select("connector_scope_id", *[F.col(c).alias(f"_{c}") for c in told.columns if c != "connector_scope_id"], F.lit(True).alias("_met"))
    return schedules.join(new, "connector_scope_id", "left"), F.col("_met").isNotNull()


def pause_schedules(schedules: DataFrame, paused: DataFrame, now: Column) -> DataFrame:
    """paused: connector_scope_id, reason_code."""
    joined, hit = _met(schedules, paused)
    return _like(joined, schedules, status=F.when(hit, "paused").otherwise(F.col("status")), pause_reason_code=F.when(hit, F.col("_reason_code")).otherwise(F.col("pause_reason_code")), paused_at=F.when(hit, now).otherwise(F.col("paused_at")))


def resume_schedules(schedules: DataFrame, resumed: DataFrame) -> DataFrame:
    """resumed: connector_scope_id, next_run_at."""
    joined, hit = _met(schedules, resumed)
    return _like(joined, schedules, status=F.when(hit, "active").otherwise(F.col("status")), next_run_at=F.when(hit, F.col("_next_run_at")).otherwise(F.col("next_run_at")), pause_reason_code=F.when(~hit, F.col("pause_reason_code")), paused_at=F.when(~hit, F.col("paused_at")))


def record_due(schedules: DataFrame, due: DataFrame) -> DataFrame:
    """schedules after their jobs were put in line, and `missed`: no longer active, or due at another time.

    due: connector_scope_id, due_at, enqueued_at, job_id, next_run_at."""
    joined, hit = _met(schedules, due)
    taken = hit & F.coalesce((F.col("status") == "active") & (F.col("next_run_at") == F.col("_due_at")), F.lit(False))
    pick = lambda new, own: F.when(taken, F.col(new)).otherwise(F.col(own))
    values = {"last_due_at": pick("_due_at", "last_due_at"), "last_enqueued_at": pick("_enqueued_at", "last_enqueued_at"), "last_job_id": pick("_job_id", "last_job_id"), "next_run_at": pick("_next_run_at", "next_run_at")}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in schedules.columns], (hit & ~taken).alias("missed"))


def purge_expired(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) > as_of))


def expire_stale(df: DataFrame, column: str, as_of: Column, limit: int, key: str = "id") -> DataFrame:
    """df without at most `limit` expired rows, oldest first."""
    old = df.filter(F.col(column) <= as_of).orderBy(column, key).limit(limit).select(key)
    return df.join(old, key, "left_anti")


def skip_finished(plan: DataFrame, run_items: DataFrame, key: str = "item_id") -> DataFrame:
    """The plan's rows that this run hasn't finished, and those that it finished with another checksum, with `is_stale`.

    plan: run_id, key, checksum; run_items: run_id, key, status, current_checksum."""
    done = run_items.filter("status in ('succeeded', 'skipped')").select("run_id", key, F.col("current_checksum").alias("_sum"), F.lit(True).alias("_done"))
    joined = plan.join(done, ["run_id", key], "left")
    stale = F.col("_done").isNotNull() & ~F.col("_sum").eqNullSafe(F.col("checksum"))
    return joined.withColumn("is_stale", stale).filter(F.col("_done").isNull() | F.col("is_stale")).select(*plan.columns, "is_stale")


def reject_stale(plan: DataFrame, catalog: DataFrame) -> DataFrame:
    """plan with `is_stale`: the catalogue no longer has the item, or another checksum than the plan expects."""
    now = catalog.select(*ITEM, F.col("source_checksum").alias("_now"), F.lit(True).alias("_there"))
    joined = plan.join(now, ITEM, "left")
    fresh = F.col("_there").isNotNull() & F.col("_now").eqNullSafe(F.col("expected_checksum"))
    return joined.withColumn("is_stale", ~fresh).drop("_now", "_there")
