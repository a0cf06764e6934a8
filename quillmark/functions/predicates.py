"""Conditions on rows, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEY_LENGTH, PATH_BYTES, PATH_SEGMENTS, SEGMENT_BYTES = 1024, 1024, 64, 255
BLOB_BYTES = 10 * 1024 * 1024
SUPPORTED = (".txt", ".md", ".markdown", ".docx", ".pdf")
#: Ids from which a list is joined and not written into the plan.
LONG_LIST = 1000
LFS_SIGNATURE = "version https://git-lfs.github.com/spec/v1"


def for_tenant(df: DataFrame, organization_id) -> DataFrame:
    return df.filter(F.col("organization_id") == organization_id)


def is_effective(start: str, end: str, revoked: str, as_of: Column) -> Column:
    """Begun by as_of, not over, and not revoked."""
    return (F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of)) & F.col(revoked).isNull()


def is_live(status: str = "status", gone: str | None = None) -> Column:
    active = F.col(status) == "active"
    return active & F.col(gone).isNull() if gone else active


def only_ids(df: DataFrame, column: str, ids: Sequence | None = None) -> DataFrame:
    """All rows if no list is given; an empty list is a mistake of the caller."""
    if ids is None:
        return df
    if not ids:
        raise ValueError(f"an empty list of {column} selects nothing")
    if len(ids) > LONG_LIST:
        listed = df.sparkSession.createDataFrame([(x,) for x in set(ids)], [column]).select(F.col(column).cast(df.schema[column].dataType))
        return df.join(listed, column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)))


def skip_reason(entry_type: str, path: str, size: str, limit: int = BLOB_BYTES, key: str | None = None) -> Column:
    """Why a tree entry can't be indexed; null if it can.  `dropped` entries, whose key is too long, leave no trace; a
    blob of a known format without a size is `size_unavailable`, a mistake of its source."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when(F.char_length(F.col(key or path)) > KEY_LENGTH, "dropped")
        .when(~F.coalesce(F.col(entry_type).isin("blob", "executable"), F.lit(False)), "unsupported_object_type")
        .when(~suffix.isin(*SUPPORTED), "unsupported_format")
        .when(F.col(size).isNull(), "size_unavailable")
        .when(F.col(size) > limit, "oversized")
    )


def entry_type(mode: str, object_type: str) -> Column:
    """What a tree entry is by its mode; null for pairs of mode and type that aren't valid."""
    m, t = F.col(mode), F.col(object_type)
    return (
        F.when((m == "040000") & (t == "tree"), "tree")
        .when((m == "100644") & (t == "blob"), "blob")
        .when((m == "100755") & (t == "blob"), "executable")
        .when((m == "120000") & (t == "blob"), "symlink")
        .when((m == "160000") & (t == "commit"), "submodule")
    )


def valid_path(path: str) -> Column:
    p, parts = F.col(path), F.split(F.col(path), "/")
    good = (F.octet_length(p) <= PATH_BYTES) & (F.size(parts) <= PATH_SEGMENTS) & ~F.contains(p, F.lit("\\")) & ~p.rlike("[\\x00-\\x1f\\x7f-\\u009f]")
    return good & ~F.exists(parts, lambda x: (x == "") | (x == ".") | (x == "..") | (F.octet_length(x) > SEGMENT_BYTES))


def json_equals(column: str, field: str, value: str) -> Column:
    return F.get_json_object(column, f"$.{field}") == value


def key_has_prefix(column: str, prefix: str) -> Column:
    return F.col(column).startswith(prefix)


def is_lfs_pointer(content: str) -> Column:
    return F.regexp_replace(F.substring_index(F.col(content), "\n", 1), "\r$", "") == LFS_SIGNATURE


def check_limit(n: int, low: int, high: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not low <= n <= high:
        raise ValueError(f"the limit must be from {low} to {high}")
    return n
