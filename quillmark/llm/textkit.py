"""Array kernels over the bytes of Arrow string columns, shared by the operators.

Words are `[^\\x20\\x09-\\x0D]+` everywhere in this package.  Rows are taken in slices of bounded
bytes, so a task's memory does not depend on the size of an Arrow batch.  One text is never cut:
a very long one makes a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.storage import cut as written, shared_folder  # noqa: F401

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 19
#: Rows in one Arrow batch: long texts then come in batches of a few megabytes.
BATCH_ROWS = 1000
#: The most rows of a side that is broadcast, and the parts that a key's rows are dealt into otherwise.
BROADCAST_ROWS, SALTS = 50_000, 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[_SPACE] = 0


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the power 0..n-1, and the inverses of these, modulo 2**64."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    both = []
    for base in (_STEP, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20)


@dataclass
class Words:
    """The words of a slice of rows.  row[i], start[i], end[i]: of word i; first[r]: row r's first word."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows from 0) of each slice; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    rows = len(offsets) - 1
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
        before[offsets[:-1][offsets[:-1] < len(solid)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(solid) + 1, bool)
    after[: len(solid)] = solid
    after[offsets[1:]] = False
    end = np.flatnonzero(solid & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, offsets, row, start, end, first)


def word_hashes(w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(w.data))
    value = _BYTE[w.data] * power[: len(w.data)]
    # bytes between words weigh 0, so a word's sum may run to the next word's start
    return mix(np.add.reduceat(value, w.start) * inverse[w.start])


def window_hashes(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each window of `size` words inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * _ODD + hashes[k : n + k]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(out[at]), at


def shingles(w: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle, by row; a row of fewer words but not none has one shingle of all."""
    h = word_hashes(w)
    out, at = window_hashes(h, w.row, size)
    row = w.row[at]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            own[there] = own[there] * _ODD + h[w.first[short[there]] + k]
        out, row = np.concatenate([out, mix(own + counts[short].astype(np.uint64))]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, one after another, and the offsets of rows."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts to a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_few(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, so that a key of many rows of left isn't one task's.

    A right side of at most BROADCAST_ROWS rows is broadcast.  A larger one is repeated SALTS times, and left's
    rows are dealt over the repetitions by a hash of its column `by`.  Keys must not be null.
    """
    right = cut(right)
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    (salt,) = fresh(left, "_salt")
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [*keys, salt], how).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
