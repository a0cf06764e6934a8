"""Substring dedup by sliding sentence spans.

A sentence ends at a word that ends in `.`, `!` or `?`, or at a line's end.  Spans are every run of SENTENCES
consecutive sentences, and, so that passages of one or two long sentences are caught as well, every shortest
run of sentences that has RUN_WORDS words, counted forwards from each sentence and backwards from each.  A run
of SENTENCES sentences counts only if it has LEAST_WORDS words: below that, equal runs are no passages (dates,
"Yes.", table cells).  Spans are hashed by their words, so white space doesn't matter.  Of equal spans in the
whole corpus the first by doc_id, text hash and place stays; every sentence that another one covers is removed.

A task sends one span of each hash on, its first among about SPANS spans; its others can't be the first of
all.  So a passage that a third of all documents share reaches the shuffle a few times a task.

Null and empty texts have no sentences, and texts of fewer than LEAST_WORDS words no spans: they stay as
they are.  Rows alike in doc_id and text are one group (null ids too): spans are searched as if it were
one row, so the first of them loses only what earlier documents have or what it repeats itself; each
other one is a copy, all of whose sentences that lie in a span are removed.  The first is chosen by the
other columns.  The rows of a group meet in one task.  A null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textkit as tk

SENTENCES, LEAST_WORDS, RUN_WORDS = 3, 12, 25
#: Spans that a task holds at once.
SPANS = 1_000_000

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of each sentence of a slice."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = _STOP[w.data[w.end - 1]]
    lines = np.searchsorted(w.start, np.flatnonzero(w.data == 10)) - 1
    stop[lines[lines >= 0]] = True
    stop[w.first[1:][w.first[1:] > 0] - 1] = True
    after = np.flatnonzero(stop) + 1
    return np.concatenate([[0], after[:-1]]), after


def spans(w: tk.Words, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first sentence, last sentence) of each span; sentences count from 0 in their row."""
    first, after = sentences(w)
    if not len(first):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    row = w.row[first]
    each = np.arange(len(first))
    forward = np.searchsorted(after, first + run_words)
    backward = np.searchsorted(first, after - run_words, "right") - 1
    a = np.concatenate([each, backward, each])
    b = np.concatenate([forward, each, each + SENTENCES - 1])
    ok = (a >= 0) & (b < len(first))
    a, b = a[ok], b[ok]
    ok = (row[a] == row[b]) & (after[b] - first[a] >= LEAST_WORDS)
    pair = np.unique(a[ok] * len(first) + b[ok])
    a, b = pair // len(first), pair % len(first)
    power, inverse = tk.powers(len(w.start) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.word_hashes(w) * power[: len(w.start)])])
    value = tk.mix((total[after[b]] - total[first[a]]) * inverse[first[a]] + (after[b] - first[a]).astype(np.uint64))
    start = np.searchsorted(row, row[a])
    return value, row[a], a - start, b - start


_SPAN = "key long, sure boolean, doc_id long, text_hash long, a int, b int"


def _task_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal spans held together the first by its own key; the others by keys that no other row has, as sure repeats.

    The same span of a row alike in doc_id and text is left out.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        doc, hashed = batch.column(0), batch.column(1).to_numpy()
        ids = np.where(doc.is_null().to_numpy(False), np.iinfo(np.int64).max, doc.fill_null(0).to_numpy())
        for at, data, offsets in tk.text_slices(batch.column(2)):
            value, row, a, b = spans(tk.words(data, offsets))
            parts.append((value.view(np.int64), ids[at + row], hashed[at + row], a.astype(np.int32), b.astype(np.int32)))
            held += len(value)
            if held > SPANS:
                yield from _firsts(parts)
                parts, held = [], 0
    if parts:
        yield from _firsts(parts)


def _firsts(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    value, ids, hashed, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a, hashed, ids, value))
    value, ids, hashed, a, b = (x[order] for x in (value, ids, hashed, a, b))
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (ids[1:] != ids[:-1]) | (hashed[1:] != hashed[:-1]) | (a[1:] != a[:-1])
    value, ids, hashed, a, b = (x[new] for x in (value, ids, hashed, a, b))
    again = np.zeros(len(value), bool)
    again[1:] = value[1:] == value[:-1]
    own = tk.mix(ids.view(np.uint64) * np.uint64(31) + hashed.view(np.uint64) + a.view(np.uint32).astype(np.uint64)).view(np.int64)
    value = np.where(again, own, value)
    for i in range(0, len(value), 50_000):
        s = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (value, again, ids, hashed, a, b)], names=["key", "sure", "doc_id", "text_hash", "a", "b"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, a, b): the sentences a to b of a text repeat earlier ones; null ids are the largest long."""
    found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_task_spans, _SPAN)
    # rows alike in doc_id and text tie for the first place, whichever tasks they come from
    place = F.rank().over(Window.partitionBy("key", "sure").orderBy("doc_id", "text_hash", "a"))
    return found.withColumn("_place", place).filter(F.col("sure") | (F.col("_place") > 1)).select("doc_id", "text_hash", "a", "b")


_OUT = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string())])


def _clean(text: str | None, runs: list | None, copy: bool = False) -> dict:
    if not text:
        return {"text": text, "n_sentences": 0, "n_removed": 0, "removed": ""}
    raw = text.encode()
    w = tk.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    first, after = sentences(w)
    if copy:
        _, _, a, b = spans(w)
        runs = [{"a": x, "b": y} for x, y in zip(a, b, strict=True)]
    if not runs:
        return {"text": text, "n_sentences": len(first), "n_removed": 0, "removed": ""}
    edge = np.zeros(len(first) + 1, np.int64)
    for r in runs:
        edge[r["a"]] += 1
        edge[r["b"] + 1] -= 1
    drop = np.cumsum(edge[:-1]) > 0
    start, end = w.start[first], w.end[after - 1]
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    out, last, broken = [], -1, False
    for i in range(len(first)):
        gap = raw[end[i - 1] if i else 0 : start[i]]
        broken = broken or b"\n" in gap
        if drop[i]:
            continue
        if last >= 0:
            out.append(gap if last == i - 1 else b"\n" if broken else b" ")
        out.append(raw[start[i] : end[i]])
        last, broken = i, False
    from_, to = np.flatnonzero(drop & ~np.concatenate([[False], drop[:-1]])), np.flatnonzero(drop & ~np.concatenate([drop[1:], [False]]))
    removed = ",".join(f"{points[start[a]]}:{points[end[b]]}" for a, b in zip(from_, to, strict=True))
    return {"text": b"".join(out).decode(), "n_sentences": len(first), "n_removed": int(drop.sum()), "removed": removed}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated sentences taken out of `text`, and n_sentences, n_removed, and removed (start:end in the old
    text's code points); columns of these names are replaced."""
    id_, hash_, runs, copy, done_ = tk.fresh(docs, "_id", "_hash", "_runs", "_copy", "_done")
    hits = repeated_spans(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias(runs))
    hits = hits.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), runs)

    @F.arrow_udf("struct<text:string,n_sentences:long,n_removed:long,removed:string>")
    def clean(column: pa.Array, runs: pa.Array, copy: pa.Array) -> pa.Array:
        return pa.array([_clean(*x) for x in zip(column.to_pylist(), runs.to_pylist(), copy.to_pylist(), strict=True)], _OUT)

    left = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(hash_, F.xxhash64("text"))
    others = [F.col(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    place = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(F.xxhash64(F.lit(0), *others)))
    left = left.withColumn(copy, place > 1)
    done = left.join(hits, [id_, hash_], "left").withColumn(done_, clean.asNondeterministic()(F.col("text"), F.col(runs), F.col(copy)))
    added = ("n_sentences", "n_removed", "removed")
    kept = [F.col(f"{done_}.text").alias("text") if c.lower() == "text" else F.col(c) for c in docs.columns if c.lower() not in added]
    return done.select(*kept, *[F.col(f"{done_}.{c}").alias(c) for c in added])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    return remove_repeats(tk.table(spark, sf_dir, "documents").select("doc_id", "text"))
