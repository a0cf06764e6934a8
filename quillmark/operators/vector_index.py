"""Exact vector search that reads a part of the chunks: blocks around pivots, and the triangle inequality.

Vectors count by their direction.  A few pivots, far from one another, are chosen from a bounded sample; a chunk
belongs to the block of its nearest pivot and its distance from it, in bands of BAND.  A block keeps the least and the
greatest distance of its chunks from each pivot, so no chunk of it can be nearer to a query than the query's own
distances from the pivots allow.  A search takes the most promising blocks first; what they give bounds the k-th
distance, and only blocks that may hold something nearer are read after that.  The result is exactly that of
`search.vector_topk` over all chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.functions.predicates import check_limit
from quillmark.operators.search import _matrix, vector_topk

#: Pivots, the sample of vectors that they are chosen from, and the width of a band of distances.
PIVOTS, SAMPLE, BAND = 8, 1000, 0.1
#: The block of vectors without a direction, or of another width; and what rounding may take from a bound.
NOWHERE, SLACK = -1, 1e-6


def _pivots(chunks: DataFrame, vector: str, key: str) -> np.ndarray:
    """Far apart directions among at most SAMPLE vectors, those whose keys have the least hashes; their width is the commonest."""
    rows = chunks.filter(F.size(vector) > 0).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h").limit(SAMPLE).collect()
    widths = [len(r["v"]) for r in rows]
    if not widths:
        return np.zeros((0, 0))
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    unit, good = _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), width)
    unit = unit[good]
    if not len(unit):
        return np.zeros((0, width))
    chosen = [0]
    near = ((unit - unit[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((unit - unit[chosen[-1]]) ** 2).sum(axis=1))
    return unit[chosen]


def build_index(chunks: DataFrame, place: str, vector: str = "embedding", key: str = "id") -> None:
    """Write chunks by blocks to place/chunks, and what a search asks first to place/blocks and place/pivots."""
    pivots = _pivots(chunks, vector, key)
    width = pivots.shape[1]

    @F.arrow_udf("struct<block:int,away:array<double>>")
    def placed(vectors: pa.Array) -> pa.Array:
        block, away = np.full(len(vectors), NOWHERE, np.int32), np.zeros((len(vectors), len(pivots)))
        if len(pivots):
            unit, good = _matrix(vectors, width)
            for p, pivot in enumerate(pivots):
                away[:, p] = np.sqrt(((unit - pivot) ** 2).sum(axis=1))
            nearest = away.argmin(axis=1)
            bands = int(2 / BAND) + 1
            block = np.where(good, nearest * bands + (away[np.arange(len(away)), nearest] / BAND).astype(np.int64), NOWHERE).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(block), pa.FixedSizeListArray.from_arrays(pa.array(away.ravel()), len(pivots)).cast(pa.list_(pa.float64())) if len(pivots) else pa.array([[]] * len(vectors), pa.list_(pa.float64()))], ["block", "away"])

    rows = chunks.withColumn("_at", placed(F.col(vector))).select(*chunks.columns, F.col("_at.block").alias("_block"), F.col("_at.away").alias("_away"))
    rows.repartition("_block").write.partitionBy("_block").parquet(f"{place}/chunks")
    stored = chunks.sparkSession.read.schema(rows.schema).parquet(f"{place}/chunks")
    ends = [f(F.col("_away")[p]).alias(f"{n}{p}") for p in range(len(pivots)) for n, f in (("low", F.min), ("high", F.max))]
    stored.groupBy("_block").agg(F.count("*").alias("n"), *ends).coalesce(1).write.parquet(f"{place}/blocks")
    chunks.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "pivot int, direction array<double>").coalesce(1).write.parquet(f"{place}/pivots")


@dataclass(frozen=True)
class Found:
    """The k nearest chunks, and how many of all chunks were read for them."""

    rows: DataFrame
    read: int
    total: int


def indexed_topk(spark: SparkSession, place: str, query: list[float], k: int, vector: str = "embedding", key: str = "id") -> Found:
    """The k nearest chunks of an index, as `vector_topk` gives them."""
    check_limit(k, 1, 100)
    pivots = np.array([r["direction"] for r in spark.read.parquet(f"{place}/pivots").orderBy("pivot").collect()])
    blocks = spark.read.parquet(f"{place}/blocks").collect()  # PIVOTS times the number of bands at most
    chunks = spark.read.parquet(f"{place}/chunks")
    shown = [c for c in chunks.columns if c not in ("_block", "_away")]
    total = sum(r["n"] for r in blocks)
    norm = float(np.linalg.norm(query))
    bound = {r["_block"]: np.inf if r["_block"] == NOWHERE else 0.0 for r in blocks}
    if len(pivots) and pivots.shape[1] == len(query) and norm > 0 and np.isfinite(norm):
        own = np.sqrt(((np.array(query) / norm - pivots) ** 2).sum(axis=1))
        for r in blocks:
            if r["_block"] != NOWHERE:
                gap = max(max(r[f"low{p}"] - d, d - r[f"high{p}"], 0.0) for p, d in enumerate(own))
                bound[r["_block"]] = max(gap - SLACK, 0.0) ** 2 / 2  # as a cosine distance
    rows_of = {r["_block"]: r["n"] for r in blocks}
    first, n = [], 0
    for b in sorted(bound, key=lambda b: (bound[b], b)):
        if n >= k:
            break
        first.append(b)
        n += rows_of[b]
    of = lambda names: vector_topk(chunks.filter(F.col("_block").isin(names)).select(shown), query, k, vector, key)
    far = of(first).agg(F.count("distance").alias("n"), F.max("distance").alias("most")).first()
    # with fewer than k distances anything may be among the nearest
    wanted = [b for b in bound if far["n"] < k or bound[b] <= far["most"] + SLACK]
    return Found(of(wanted), sum(rows_of[b] for b in {*first, *wanted}), total)
