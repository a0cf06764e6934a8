"""Functions of columns."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column, functions as F

MIME_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
BASE_DELAY, DELAY_CAP, RATE_CAP = 30.0, 900.0, 3600.0
# Forms of codes and names.
PATTERNS = {"code": "^[a-z][a-z0-9_]*$", "slug": "^[a-z0-9]+(-[a-z0-9]+)*$", "object_id": "^([0-9a-f]{40}|[0-9a-f]{64})$", "worker": "^[A-Za-z0-9][A-Za-z0-9._:-]{0,254}$", "profile": "^[a-z0-9][a-z0-9._:/-]*$"}


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null if either vector is null or has no length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(wide(v), lambda x: x * x), F.lit(0.0), add))
    return F.lit(1.0) - F.try_divide(dot, norm(a) * norm(b))


def sha256_hex(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def normalize_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def trim_unicode(s: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def email_domain(s: Column) -> Column:
    """The part after the first @ up to the next, as stored; null without a name before it.

    By places of the sign: `split_part` compiles a pattern for each row.
    """
    return F.when(F.instr(F.btrim(s), "@") > 1, F.nullif(F.substring_index(F.substring_index(s, "@", 2), "@", -1), F.lit("")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^./]+$", "$1")


def normalize_ext(s: Column) -> Column:
    lowered = F.lower(F.btrim(s))
    return F.when(lowered == "", None).when(lowered.startswith("."), lowered).otherwise(F.concat(F.lit("."), lowered))


def mime_of(ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair]), ext)


def next_run(anchor: Column, seconds: Column, now: Column) -> Column:
    """The first time of the grid anchor + i * seconds that is after now; the anchor itself if it is."""
    steps = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp"))) / (seconds.cast("long") * 1_000_000)) + 1
    return F.when(anchor > now, anchor.cast("timestamp")).otherwise(F.timestamp_add("SECOND", (steps * seconds).cast("long"), anchor.cast("timestamp")))


def retry_delay(kind: Column, attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait: what a rate limit says, up to RATE_CAP, else the jitter's share of a doubling ceiling."""
    ceiling = F.least(F.lit(BASE_DELAY) * F.pow(F.lit(2.0), attempt - 1), F.lit(DELAY_CAP))
    return F.when((kind == "rate_limited") & retry_after.isNotNull(), F.least(retry_after, F.lit(RATE_CAP))).otherwise(jitter * ceiling)


def profile_fingerprint(profile: dict) -> str:
    return hashlib.sha256(json.dumps(profile, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def collision_key(name) -> Column:
    """Names that one file system can't tell apart have one key.  Spark has no NFC or case folding."""
    fold = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold()), "string")
    return fold(name)


def repo_item_key(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("github:repository:"), repository.cast("string"), F.lit(":path:"), path)


def matches(column: Column, kind: str) -> Column:
    return column.rlike(PATTERNS[kind])


def json_field(column: Column, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")


def json_time(column: Column, name: str) -> Column:
    """A field that holds an ISO time, as a timestamp; null if it holds none."""
    return F.try_to_timestamp(json_field(column, name))


def numeric_id(*keys: Column) -> Column:
    """An id of 60 bits that depends on the keys only."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256), 1, 15), 16, 10).cast("long")


def row_id(*keys: Column) -> Column:
    """An id that depends on the keys only, so reruns agree."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")) for k in keys]), 256)
