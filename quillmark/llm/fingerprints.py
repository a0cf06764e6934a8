"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches are as long as their
texts are, containment can be estimated between texts of very different lengths, and the sketch of a union is
the union of sketches (`merge`).  A text of at most WHOLE shingles keeps all of its hashes, and says so.

Two sketches are compared under the lower of their ceilings: hashes above it count on neither side, as only one
of them could hold these.  Two short texts are compared exactly.  Where a short text has no hash below a long
one's ceiling nothing is known of it, and it counts as not contained: for a text of n shingles that happens in
(1 - FRACTION)**n of all cases, 1 in 16 for 8 words and 1 in 65,536 for 20 words.

Nulls and texts without words have the empty sketch; two empty sketches are alike (1), an empty
and another are not (0).  Repeated rows give repeated results.  Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

#: The kept fraction of hashes, and the number of shingles up to which all are kept.
FRACTION, WHOLE = 1 / 2, 64
#: Hashes are cut to this many bytes: chance matches of one pair of sketches stay below one in 10^7.
HASH_BYTES = 6
#: Buckets of neighbouring ids for each shuffle partition, and at most.
BUCKETS_A_PARTITION, MOST_BUCKETS = 4, 4096


class Sketch(NamedTuple):
    """Sorted distinct hashes; whole if no hash of the text is missing."""

    hashes: np.ndarray
    whole: bool


def _ceiling(fraction: float) -> np.uint64:
    return np.uint64(int(fraction * (1 << (8 * HASH_BYTES))))


def sketches(column: pa.Array, fraction: float = FRACTION) -> list[Sketch]:
    """The sketch of each text."""
    out: list[Sketch] = []
    ceiling = _ceiling(fraction)
    for _, data, offsets in tk.text_slices(column):
        value, row = tk.shingles(tk.words(data, offsets))
        rows = len(offsets) - 1
        value, bounds = tk.distinct_by_row(value >> np.uint64(64 - 8 * HASH_BYTES), row, rows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = value[a:b]
            out.append(Sketch(own, True) if b - a <= WHOLE else Sketch(own[: np.searchsorted(own, ceiling)], False))
    return out


def encode(sketch: Sketch) -> str:
    """A letter, w for whole and s for scaled, and base64 of the hashes, each in HASH_BYTES big-endian bytes."""
    if not len(sketch.hashes) and sketch.whole:
        return ""
    raw = sketch.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()
    return ("w" if sketch.whole else "s") + base64.b64encode(raw).decode()


def decode(text: str) -> Sketch:
    raw = np.frombuffer(base64.b64decode(text[1:]), np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = raw
    return Sketch(out.view(">u8").reshape(-1).astype(np.uint64), text[:1] != "s")


def _comparable(a: Sketch, b: Sketch, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both that either could hold."""
    if a.whole == b.whole:
        return a.hashes, b.hashes
    ceiling = _ceiling(fraction)
    return a.hashes[: np.searchsorted(a.hashes, ceiling)], b.hashes[: np.searchsorted(b.hashes, ceiling)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def containment(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """The estimated share of a's shingles that b has."""
    if a.whole and not len(a.hashes):
        return 1.0 if b.whole and not len(b.hashes) else 0.0
    x, y = _comparable(a, b, fraction)
    return _common(x, y) / len(x) if len(x) else 0.0


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """The larger containment: of the shorter text in the longer."""
    empty = [x.whole and not len(x.hashes) for x in (a, b)]
    if any(empty):
        return float(all(empty))
    x, y = _comparable(a, b, fraction)
    less = min(len(x), len(y))
    return _common(x, y) / less if less else 0.0


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION) -> Sketch:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a.hashes, b.hashes)
    if a.whole and b.whole and len(both) <= WHOLE:
        return Sketch(both, True)
    return Sketch(both[: np.searchsorted(both, _ceiling(fraction))], False)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", fraction: float = FRACTION) -> DataFrame:
    """docs with the encoded sketch of `text` as column `out` (which replaces one of that name)."""

    @F.pandas_udf("string")
    def sketch(column):
        return column.__class__([encode(x) for x in sketches(pa.array(column, pa.string()), fraction)])

    return docs.withColumn(out, sketch(F.col(text)))


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, last, key, text), a bucket's rows together and in descending order of key.

    Buckets hold neighbouring keys.  Rows with `last` set end a bucket: they are copies of the rows
    with the largest key of the next lower bucket (of the first bucket, for the lowest), so every
    row's successor follows it.  A bucket is read as a stream, so its size is no matter of memory, and splits
    and bucket heads are at most MOST_BUCKETS; texts are shuffled once.  A null key counts as the lowest.
    """
    spark = docs.sparkSession
    wanted = min(BUCKETS_A_PARTITION * tk.shuffle_partitions(spark), MOST_BUCKETS)
    ordered = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_k"), F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ids = ordered.select("_k")
    splits = ids.select(F.percentile_approx("_k", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("s")).first()["s"] or []
    splits = sorted(set(splits))
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    if splits:
        edges = F.array(*[F.lit(x) for x in splits])
        # binary search: how many splits are below the key
        bucket = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < F.col("_k"), at + step).otherwise(at))
    else:
        bucket = F.lit(0)
    heads = {r["b"]: r["k"] for r in ids.groupBy(bucket.alias("b")).agg(F.max("_k").alias("k")).collect()}
    filled = sorted(heads)
    ends = [(heads[b], filled[(i + 1) % len(filled)]) for i, b in enumerate(filled)] or [(0, 0)]
    copies = F.broadcast(spark.createDataFrame(ends, "_k long, _to int"))
    own = ordered.select(bucket.alias("_bucket"), F.lit(False).alias("_last"), "_k", "_id", "_text")
    extra = ordered.join(copies, "_k").select(F.col("_to").alias("_bucket"), F.lit(True).alias("_last"), "_k", "_id", "_text")
    return own.unionByName(extra).repartition("_bucket").sortWithinPartitions("_bucket", "_last", F.desc("_k"), "_text")


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next text's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            held = rows.slice(rows.num_rows - 1).combine_chunks()
            for at in range(0, rows.num_rows - 1, 256):
                yield from pairs(rows.slice(at, 257))

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, last = rows["_bucket"].to_numpy(), rows["_last"].to_numpy()
        texts, n = rows["_text"].to_pylist(), rows.num_rows
        owner = np.flatnonzero(~last[: n - 1] & (bucket[: n - 1] == bucket[1:n]))
        if not len(owner):
            return
        edited = [texts[i][: len(texts[i]) - (len(texts[i]) // 2)] + texts[i + 1][: len(texts[i]) // 2] for i in owner]
        own, other = sketches(rows["_text"].combine_chunks(), fraction), sketches(pa.array(edited, pa.string()), fraction)
        yield pa.RecordBatch.from_arrays(
            [
                rows["_id"].take(pa.array(owner)).combine_chunks().cast(pa.int64()),
                pa.array([len(texts[i]) for i in owner], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([encode(own[i]) for i in owner]),
                pa.array([encode(x) for x in other]),
                pa.array([likeness(own[i], x, fraction) for i, x in zip(owner, other, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1], fraction) for i in owner], pa.float64()),
            ],
            schema=_EDITED,
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).mapInArrow(run, schema)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    return edited_fingerprints(tk.table(spark, sf_dir, "documents"))
