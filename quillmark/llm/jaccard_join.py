"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts with equal sets of five-word shingles form one class first.  A class has one label in each of TREES
trees: DEPTH min-hashes, of which 16 bits are kept.  A tree's labels are sorted, so a prefix's classes stand
together: the trie.  Each class starts at its longest common prefixes and shortens them one min-hash at a
time.  At each length the classes met so far have estimated similarities s, and a class of similarity s is
met in some tree with probability 1 - (1 - s**length)**TREES; so the number met and the number that this
many stand for give the recall so far.  A class stops at the length where that is RECALL or more; one that
has met none goes on to `least_depth`, where pairs just at the threshold are met with that recall.

Classes met are candidates unless their sizes alone rule them out, or their estimate is MARGIN below the
threshold: of 10 million pairs at the threshold, TREES * DEPTH min-hashes put about 7 there (`missed`).
Candidates that hang together form a group; each group's shingle sets then meet once, in blocks, and every
pair of a group is verified exactly; links are counted, not listed, and a tree of them goes on to the
components.

A prefix of the least depth that more than BUCKET classes share, and a group of more than BLOCK classes or
BLOCK_SHINGLES shingles, is cut into blocks, and each pair of blocks is one piece of work.

Null texts count as empty; texts without words are alike one another only.  A text of fewer than five
words has one shingle, of all its words.  Repeated rows and copies count as links of one another.
A class of documents bears its least doc_id, null if it has no other.  Rows are told apart by doc_id and
text, so different texts may bear one doc_id, or none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textkit as tk
from .components import components, forest, tree_edges

THRESHOLD, RECALL = 0.8, 0.999
TREES, DEPTH = 12, 6
MARGIN = 0.25
BUCKET, BLOCK, BLOCK_SHINGLES = 8192, 512, 400_000

_RANDOM = np.random.default_rng(7)
_FACTOR = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)

#: A null doc_id comes last.
_NO_ID = (1 << 63) - 1


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def met(similarity, length: int):
    """The probability that two classes share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** TREES


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold are met with the target recall."""
    return next((d for d in range(DEPTH, 1, -1) if met(threshold, d) >= recall), 1)


def missed(threshold: float = THRESHOLD, margin: float = MARGIN) -> float:
    """The share of pairs at the threshold whose estimate is more than the margin below it."""
    n = TREES * DEPTH
    return sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(math.ceil((threshold - margin) * n)))


def signatures(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """16 bits of each min-hash of each row; rows without shingles have zeros."""
    out = np.zeros((rows, TREES * DEPTH), ">u2")
    bounds = np.searchsorted(row, np.arange(rows + 1))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat(value * _FACTOR[k] + _TERM[k], bounds[some])
            out[some, k] = tk.mix(least) & np.uint64(0xFFFF)
    return out


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of rows one after another, offsets) of each slice."""
    for at, data, offsets in tk.text_slices(column):
        value, row = tk.shingles(tk.words(data, offsets))
        yield at, *tk.distinct_by_row(value, row, len(offsets) - 1)


def set_ids(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes that name each set."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for k in range(2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(value + np.uint64(k * 0x5DEECE66D + 1)))])
        out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


_FEATURES = "doc_id long, text_hash long, cid binary, n long, sig binary, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's class, number of shingles, labels, and a byte of each min-hash."""
    for batch in batches:
        for at, value, bounds in shingle_sets(batch.column(2)):
            rows = len(bounds) - 1
            n = np.diff(bounds)
            sig = signatures(value, np.repeat(np.arange(rows), n), rows)
            parts = [_fixed(set_ids(value, bounds)), pa.array(n.astype(np.int64)), _fixed(sig), _fixed((sig & 0xFF).astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), *parts], names=["doc_id", "text_hash", "cid", "n", "sig", "sketch"])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, of sorted batches; runs of one row are left out."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        code = [rows[k].combine_chunks().dictionary_encode().indices.to_numpy() for k in keys]
        new = np.zeros(rows.num_rows, bool)
        for c in code:
            new[1:] |= c[1:] != c[:-1]
        own = [rows[k][0].as_py() for k in keys] if rows.num_rows else last
        starts = [0, *np.flatnonzero(new).tolist(), rows.num_rows]
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if i or own != last:
                if held:
                    yield from _whole(held)
                held = []
            if b - a > 1 or i == 0 or b == rows.num_rows:
                held.append(rows.slice(a, b - a))
        if rows.num_rows:
            last = [rows[k][rows.num_rows - 1].as_py() for k in keys]
    if held:
        yield from _whole(held)


def _whole(held: list[pa.Table]) -> Iterator[pa.Table]:
    out = pa.concat_tables(held) if len(held) > 1 else held[0]
    if out.num_rows > 1:
        yield out.combine_chunks()


def _edges(ids: pa.ChunkedArray, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        a, b = tree_edges(part)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few large batches of many small ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > 20_000 or len(held) > 2000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _in_blocks(rows: DataFrame, blocks, *keys: str) -> DataFrame:
    """rows once for each pair of blocks that its block is part of: `own`, and the pair's `low` and `high`."""
    own = F.pmod(F.xxhash64("cid"), F.greatest(blocks, F.lit(1))).cast("int")
    out = rows.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)).cast("int") - 1)))
    return out.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other")).drop("_other")


def trie_components(label: np.ndarray, sketch: np.ndarray, size: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> list[np.ndarray]:
    """The candidates among rows of one tree, sorted by label, that share a prefix of the least depth: those that hang together.

    Rows that hang together by longer prefixes are not compared again, so a large group of near copies
    takes a few passes over its rows.
    """
    n, width = sketch.shape
    floor, least = least_depth(threshold, recall), (threshold - MARGIN) * width

    def likely(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = (sketch[others] == sketch[i]).sum(axis=1)
        return (same >= least) & (np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i])), same / width

    if n == 2:
        return [np.arange(2)] if likely(0, np.array([1]))[0][0] else []
    shared = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.uint8).sum(axis=1)
    part, going = np.arange(n), np.ones(n, bool)
    found, stands_for = np.zeros(n), np.zeros((n, DEPTH + 1))
    for d in range(DEPTH, floor - 1, -1):
        starts = np.flatnonzero(np.concatenate([[True], shared < d]))
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if b - a < 2 or not going[a:b].any() or (part[a:b] == part[a]).all():
                continue
            left = np.arange(a, b)
            while len(left) > 1:
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    hit, similarity = likely(i, left)
                    hit &= going[i] | going[left]
                    if not hit.any():
                        continue
                    met_now, similarity = left[hit], np.maximum(similarity[hit], 1 / width)
                    queue += met_now.tolist()
                    left = left[~hit]
                    # pairs that share a longer prefix were met before
                    new = label[met_now, d] != label[i, d] if d < DEPTH else np.ones(len(met_now), bool)
                    found[met_now[new]] += 1
                    found[i] += new.sum()
                    for k in range(floor, d + 1):
                        weight = 1 / met(similarity[new], k)
                        stands_for[met_now[new], k] += weight
                        stands_for[i, k] += weight.sum()
                    part[np.isin(part, np.unique(part[met_now]))] = part[i]
        going &= (found == 0) | (found < recall * stands_for[:, d])
    order = np.argsort(part, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x) > 1]


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Trees (a, b, n) of classes that are candidates of one another."""
    floor = least_depth(threshold)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = F.expr(f"concat(unhex(lpad(hex(tree), 2, '0')), substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH}))").alias("label")
    keyed = classes.filter("n > 0").select(tree, "cid", "n", "sig", "sketch").select(label, "cid", "n", "sketch").withColumn("trunk", F.expr(f"substring(label, 1, {1 + 2 * floor})"))
    crowded = tk.cut(keyed.groupBy("trunk").agg(F.count("*").alias("_many")).filter(F.col("_many") > BUCKET))
    if crowded.isEmpty():
        keyed = keyed.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    else:
        keyed = tk.join_few(keyed, crowded, ["trunk"], "cid", "left")
        keyed = _in_blocks(keyed, F.ceil(F.coalesce("_many", F.lit(1)) / BUCKET)).drop("_many", "own")
    keys = ["trunk", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            n = rows.num_rows
            labels = np.frombuffer(b"".join(rows["label"].to_pylist()), np.uint8).reshape(n, -1)[:, 1:]
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(n, -1)
            yield from _edges(rows["cid"], trie_components(np.ascontiguousarray(labels).view(">u2"), sketch, rows["n"].to_numpy(), threshold))

    spread = keyed.repartition(*keys).sortWithinPartitions(*keys, "label", "cid")
    return spread.mapInArrow(lambda x: _gathered(run(x)), "a binary, b binary, n long")


def overlaps(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many values each two of the sets share."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    keep = often[code]
    doc, code = doc[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    out = np.zeros((n, n), np.float32)
    step = 4096
    for start in range(0, int(often.sum()), step):
        a, b = np.searchsorted(code, [start, start + step])
        part = np.zeros((n, step), np.float32)
        part[doc[a:b], code[a:b] - start] = 1
        out += part @ part.T
    return out


def verified(docs: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, b, n): with a = b a class and how many documents of other classes it is linked to in one
    piece of work; else an edge of a tree of links.  members: cid, rep, copies, n and group."""
    sizes = members.groupBy("group").agg(F.count("*").alias("_classes"), F.sum("n").alias("_shingles"))
    blocks = F.ceil(F.greatest(F.col("_classes") / BLOCK, F.col("_shingles") / BLOCK_SHINGLES))
    sized = tk.join_few(members, sizes.filter((F.col("_classes") > BLOCK) | (F.col("_shingles") > BLOCK_SHINGLES)), ["group"], "cid", "left")
    placed = tk.cut(sized.select("rep.*", "cid", "copies", "group", F.coalesce(blocks, F.lit(1)).cast("long").alias("blocks")))
    texts = docs.select(_id().alias("id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(placed, ["id", "text_hash"]).drop("id", "text_hash")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.names.index("cid"))
            for at, value, bounds in shingle_sets(batch.column(batch.schema.names.index("text"))):
                rows = len(bounds) - 1
                packed = pa.array([value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                part = {k: batch.column(batch.schema.names.index(k)).slice(at, rows) for k in ("cid", "copies", "group", "blocks")}
                same = pa.array([x == y for x, y in zip(_fixed(set_ids(value, bounds)).to_pylist(), own.slice(at, rows).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*part.values(), packed], names=[*part, "shingles"]).filter(same)

    spread = _in_blocks(rows.mapInArrow(sets, "cid binary, copies long, group binary, blocks long, shingles binary"), F.col("blocks")).drop("blocks")
    keys = ["group", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            ids = rows["cid"].to_pylist()
            first = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
            rows = rows.filter(pa.array(first)).combine_chunks()
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets])
            bounds = np.concatenate([[0], np.cumsum(size)])
            both = overlaps(np.concatenate(sets), bounds)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            own, low, high = rows["own"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
            if low != high:  # pairs inside a block are another piece's
                linked &= own[:, None] != own[None, :]
            weight = linked @ rows["copies"].to_numpy().astype(np.float64)
            some = np.flatnonzero(weight > 0)
            if len(some):
                c = rows["cid"].combine_chunks().take(pa.array(some)) if isinstance(rows["cid"], pa.ChunkedArray) else rows["cid"].take(pa.array(some))
                yield pa.RecordBatch.from_arrays([c, c, pa.array(weight[some].astype(np.int64))], names=["a", "b", "n"])
                yield from _edges(rows["cid"], forest(lambda i, others, m=linked: m[i, others], len(size)))

    sorted_ = spread.repartition(*keys).sortWithinPartitions(*keys, "cid")
    return sorted_.mapInArrow(lambda x: _gathered(run(x)), "a binary, b binary, n long")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, cid) of every row; and of every class (cid, rep, least, n_links): rep is its first
    row's id and text_hash, least that of all classes it hangs together with."""
    rows = tk.cut(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(_features, _FEATURES))
    classes = tk.cut(rows.groupBy("cid").agg(F.min(F.struct(_id().alias("id"), "text_hash")).alias("rep"), F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("n", "sig", "sketch")]))
    groups = components(candidate_edges(classes, threshold)).select(F.col("node").alias("cid"), F.col("label").alias("group"))
    members = classes.drop("sig", "sketch").join(groups, "cid")
    found = tk.cut(verified(docs, members, threshold))
    clusters = tk.cut(components(found.filter("a <> b")).select(F.col("node").alias("cid"), "label").join(classes.select("cid", "rep"), "cid"))
    least = tk.join_few(clusters.select("cid", "label"), clusters.groupBy("label").agg(F.min("rep").alias("least")), ["label"], "cid").drop("label")
    links = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    named = classes.select("cid", "rep", "copies").join(links, "cid", "left").join(least, "cid", "left")
    return rows.select("doc_id", "text_hash", "cid"), tk.cut(named.select("cid", "rep", F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: links are the other documents that are alike enough."""
    rows, named = _classes(docs, threshold)
    class_id = F.when(F.col("least.id") < _NO_ID, F.col("least.id")).alias("class_id")
    return tk.join_few(rows, named.select("cid", class_id, "n_links"), ["cid"], "doc_id").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row by doc_id and text of each class, with docs' columns; of rows alike in both one."""
    _, named = _classes(docs, threshold)
    id_, hash_, place = tk.fresh(docs, "_id", "_text_hash", "_place")
    kept = named.filter("rep = least").select(F.col("rep.id").alias(id_), F.col("rep.text_hash").alias(hash_))
    others = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.withColumn(id_, _id()).withColumn(hash_, F.xxhash64("text"))
    first = rows.withColumn(place, F.row_number().over(Window.partitionBy(id_, hash_).orderBy(F.xxhash64(F.lit(0), *others)))).filter(F.col(place) == 1)
    return first.join(kept, [id_, hash_], "left_semi").select(*docs.columns)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    return near_classes(tk.table(spark, sf_dir, "documents"))
