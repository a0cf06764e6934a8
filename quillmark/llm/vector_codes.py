"""Vector code compression: a product quantizer in integers, trained with LAESA pivots.

A component x counts as the integer floor(256 * x); a vector is cut into PARTS consecutive parts, and a part's
code is its nearest entry in that part's codebook (squared Euclidean distance, ties to the lower index).  The
codebooks start from the ENTRIES rows of least id, and ROUNDS times each entry becomes the componentwise
floor of its parts' mean.

PIVOTS of a part's first entries are its pivots, for good.  The distances of all parts to their pivots are
computed once and written beside the integers.  In each round only the distances between pivots and entries are
new: |d(part, pivot) - d(pivot, entry)| is below d(part, entry), so entries are tried in the order of this
bound, and a part is done when the next bound is above its best exact distance.  Bounds are rounded down, exact
distances are 64-bit integers, so nothing depends on rounding.

A task sends PARTS * ENTRIES sums, whatever its rows; the driver holds the codebooks and nothing else.

Rows whose vector is null, or holds a null or a component that isn't finite, are dropped.  The width is that of
most vectors (the largest of those that tie); vectors of another width stay, with null code and error.  Parts are
equal where PARTS divides the width, else they differ by one component.  Components beyond LIMIT / 256 count as
that.  Rows of equal id are ordered by their vectors, null ids come last; of fewer rows than ENTRIES all are
entries.  Other columns are kept, whatever their names, but for the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 16, 64, 2, 4, 256
#: The largest integer of a component: squared distances of up to 2,000 components stay below 2**63.
LIMIT = 1 << 25
#: Relative slack of a bound between two distances held as 32-bit floats.
SLACK = np.float32(4e-7)


@dataclass(frozen=True)
class Codebooks:
    """edges: where parts begin and end; entries: of each part, [entry, component]; pivots: of each part, [pivot, component]."""

    edges: list[int]
    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.edges[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def is_finite(vector: str) -> Column:
    """The vector is there and all of its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def integers(components: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(components.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def edges(width: int) -> list[int]:
    return [p * width // PARTS for p in range(PARTS + 1)]


def far_apart(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Some entries, each the farthest from those before it; the first is the farthest from the first entry."""
    if not len(entries):
        return entries
    squared = lambda i: ((entries - entries[i]) ** 2).sum(axis=1)
    chosen = [int(squared(0).argmax())]
    near = squared(chosen[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(chosen[-1]))
    return entries[chosen]


def pivot_distances(values: np.ndarray, books: Codebooks) -> np.ndarray:
    """[row, part, pivot]: distances as 32-bit floats."""
    out = []
    for lo, hi, pivots in zip(books.edges[:-1], books.edges[1:], books.pivots, strict=True):
        part = values[:, lo:hi].astype(np.int64)
        out.append(np.stack([np.sqrt(((part - p) ** 2).sum(axis=1)) for p in pivots], axis=1))
    return np.stack(out, axis=1).astype(np.float32)


def nearest(part: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, exact evaluations) of a part of each row."""
    between = np.sqrt(((pivots[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)).astype(np.float32)
    bound = np.zeros((len(part), len(entries)), np.float32)
    for k in range(len(pivots)):
        own = to_pivots[:, k, None]
        np.maximum(bound, np.abs(own - between[k]) - SLACK * (own + between[k]), out=bound)
    best, index = np.full(len(part), np.iinfo(np.int64).max), np.full(len(part), len(entries))
    live, tried = np.arange(len(part)), 0
    while len(live):
        at = bound.argmin(axis=1)
        least = bound[np.arange(len(live)), at].astype(np.float64)
        open_ = least * least <= best[live]
        if not open_.all():
            live, bound, at = live[open_], bound[open_], at[open_]
        exact = ((part[live] - entries[at]) ** 2).sum(axis=1)
        tried += len(live)
        closer = (exact < best[live]) | ((exact == best[live]) & (at < index[live]))
        best[live[closer]], index[live[closer]] = exact[closer], at[closer]
        bound[np.arange(len(live)), at] = np.inf
        # a row of which all entries were tried has infinite bounds only
    return index, best, tried


def assign(values: np.ndarray, to_pivots: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """([row, part] index, [row, part] squared distance, exact evaluations)."""
    found = [nearest(values[:, lo:hi].astype(np.int64), to_pivots[:, p], books.entries[p], books.pivots[p]) for p, (lo, hi) in enumerate(zip(books.edges[:-1], books.edges[1:], strict=True))]
    return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1), sum(x[2] for x in found)


def _rows(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have this width, and these as rows."""
    fits = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
    return fits, lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), width)


def _lists(values: np.ndarray, fits: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row, null where it doesn't fit."""
    sizes = np.where(fits, values.shape[1] if values.ndim > 1 else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind), mask=pa.array(~fits))


def start(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """The codebooks before the first round; None if no vector is kept."""
    rows = vectors.filter(is_finite(vector)).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return None
    width = common["width"]
    first = rows.filter(F.size("v") == width).orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).collect()
    values = integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), width)).astype(np.int64)
    ends = edges(width)
    entries = [values[:, lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    return Codebooks(ends, entries, [far_apart(x) for x in entries])


def _means(prepared: DataFrame, ints: str, pivots: str, books: Codebooks) -> Codebooks:
    """The codebooks after a round: each entry the floor of the mean of its parts, unused ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(hi - lo for lo, hi in zip(books.edges[:-1], books.edges[1:], strict=True)) + 1
        total = np.zeros((PARTS, ENTRIES, width), np.int64)  # the last of an entry is its count
        for batch in batches:
            _, values = _rows(batch.column(0), books.width)
            _, near = _rows(batch.column(1), PARTS * len(books.pivots[0]))
            index, _, _ = assign(values, near.reshape(len(values), PARTS, len(books.pivots[0])), books)
            for p, (lo, hi) in enumerate(zip(books.edges[:-1], books.edges[1:], strict=True)):
                for k in range(lo, hi):  # sums of a batch are below 2**53
                    total[p, :, k - lo] += np.bincount(index[:, p], values[:, k], minlength=ENTRIES).astype(np.int64)
                total[p, :, -1] += np.bincount(index[:, p], minlength=ENTRIES)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place], pa.int64())], names=["place", "total"])

    sums = prepared.select(ints, pivots).mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    width = max(hi - lo for lo, hi in zip(books.edges[:-1], books.edges[1:], strict=True)) + 1
    found = {r["place"]: int(r["total"]) for r in sums.collect()}  # PARTS * ENTRIES * width at most
    entries = []
    for p, old in enumerate(books.entries):
        new = old.copy()
        for e in range(len(old)):
            at = (p * ENTRIES + e) * width
            if n := found.get(at + width - 1, 0):
                new[e] = [found.get(at + k, 0) // n for k in range(old.shape[1])]
        entries.append(new)
    return Codebooks(books.edges, entries, books.pivots)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """vectors without those that aren't finite, with `code` and `error` in place of the vector, and the codebooks."""
    ints, pivots, code, error = tk.fresh(vectors, "_ints", "_pivots", "code", "error")
    others = [c for c in vectors.columns if c != vector]
    books = start(vectors, id, vector)
    if books is None:
        return vectors.filter(F.lit(False)).select(*others, F.lit(None).cast("string").alias(code), F.lit(None).cast("long").alias(error)), None
    rows = vectors.filter(is_finite(vector)).select(*others, F.col(vector).cast("array<double>").alias(ints))
    first = books

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, values = _rows(batch.column(len(others)), first.width)
            values = integers(values)
            near = pivot_distances(values, first).reshape(len(values), PARTS * len(first.pivots[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(values, fits, pa.int32()), _lists(near, fits, pa.float32())], names=[*others, ints, pivots])

    wide = rows.select(*others, F.lit(None).cast("array<int>").alias(ints), F.lit(None).cast("array<float>").alias(pivots))
    prepared = tk.written(rows.mapInArrow(prepare, wide.schema))
    for _ in range(ROUNDS):
        books = _means(prepared, ints, pivots, books)
    last = books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, values = _rows(batch.column(len(others)), last.width)
            _, near = _rows(batch.column(len(others) + 1), PARTS * len(last.pivots[0]))
            index, squared, _ = assign(values, near.reshape(len(values), PARTS, len(last.pivots[0])), last)
            digits = index.astype(np.uint8).tobytes().hex()
            codes, errors = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            codes[fits] = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            errors[fits] = squared.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], names=[*others, code, error])

    coded = prepared.select(*others, F.lit(None).cast("string").alias(code), F.lit(None).cast("long").alias(error))
    return prepared.mapInArrow(encode, coded.schema), books


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", by: str = "vec_id") -> DataFrame:
    """coded with `label_error`, the error of all rows of equal label; nulls are equal.  Null beyond 64 bits."""
    key, total = tk.fresh(coded, "_label", "label_error")
    rows = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    sums = rows.groupBy(key).agg(F.sum(F.col(error).cast("decimal(20,0)")).alias(total))
    return tk.join_few(rows, sums.withColumn(total, F.expr(f"try_cast(`{total}` AS bigint)")), [key], by).drop(key)


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    coded, books = compress(tk.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    rows = with_label_error(tk.written(coded))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_sql() -> str:
    """The same for DuckDB, every part against every entry."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""away{k} AS (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM parts JOIN book{k} USING (p, i) GROUP BY vec_id, p, e),
  near{k} AS (SELECT vec_id, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d * {ENTRIES} + e) // {ENTRIES} AS d FROM away{k} GROUP BY vec_id, p)""")
        if k < ROUNDS:
            rounds.append(f"""sum{k} AS (SELECT p, e, i, sum(x)::HUGEINT AS s, count(*) AS n FROM parts JOIN near{k} USING (vec_id, p) GROUP BY p, e, i),
  book{k + 1} AS (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM book{k} LEFT JOIN sum{k} USING (p, e, i))""")
    return f"""WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR NOT isfinite(x))),
  long AS (SELECT vec_id, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x, generate_subscripts(embedding, 1) - 1 AS j, len(embedding) // {PARTS} AS w FROM kept),
  parts AS (SELECT vec_id, j // w AS p, j % w AS i, x FROM long),
  first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
  book0 AS (SELECT p, e, i, x AS c FROM parts JOIN first USING (vec_id)),
  {", ".join(rounds)},
  coded AS (SELECT vec_id, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
  digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""
