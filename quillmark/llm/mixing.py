"""Mixing sources to target weights by subset-sum budget fitting over document lengths.

A source's target is its share of all sizes by weight, at most REPEATS times its own size; what is
over goes to the others by weight.  Whole passes over a source come first; what is left of the target
is filled from a count of documents by exact length: a proportional part of each length, then single
documents, then a bounded-knapsack dynamic program that meets the last words exactly where lengths
allow it.  For each length so many documents are picked in the order of a seeded hash, which is cut
into blocks of about BLOCK documents, so a length that many documents share isn't ordered in one task.

Null text has size 0, and a null source is a source of its own, the last.  Documents of size 0 are
never taken.  Rows are told apart by doc_id, text, source and size; rows alike in all of these share what is
taken of them evenly.  A source or a length of a third of all rows is dealt over tasks.  Reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkit as tk

if TYPE_CHECKING:  # workers that don't need it don't load it
    import pandas as pd

#: Weights of sources in the order of their names, repeating, and the most times a source may be taken.
WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 20240501
#: Words up to which the dynamic program fills a budget, and documents of one length ordered together.
EXACT_WORDS = 1 << 15
BLOCK = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of source and size."""
    totals = tk.cut(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    ordered = totals.orderBy(F.asc_nulls_last("source"))
    n = len(WEIGHTS)
    weighted = ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], WEIGHTS[x[1] % n]))
    sources = tk.cut(sized.sparkSession.createDataFrame(weighted, "source string, source_size long, weight int"))
    cap = REPEATS * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, left = F.lit(False), float(total)
    level = 0.0
    while True:
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0)).alias("capped"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"), F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if not row["weight"]:
            break
        left = total - (row["capped"] or 0)
        level = left / row["weight"]
        now = F.col("weight") * F.lit(level) > cap
        if sources.filter(now).count() == row["n"]:
            break
        full = now
    over = F.col("weight") * F.lit(level) > cap
    return sources.select("source", "source_size", F.when(full | over, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def fit_budget(size: np.ndarray, count: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each size to take: at most count, together as near below the budget as can be."""
    order = np.argsort(size)
    size, count = size[order].astype(np.int64), np.where(size[order] > 0, count[order], 0).astype(np.int64)
    total = int((size * count).sum())
    take = np.zeros(len(size), np.int64)
    if budget > 0 and total:
        budget = min(budget, total)
        share = count * (budget / total)
        take = np.minimum(np.floor(share).astype(np.int64), count)
        left = budget - int((take * size).sum())
        # single documents, from the largest part of a document that is missing
        for i in np.argsort(-(share - take), kind="stable"):
            if left <= EXACT_WORDS:
                break
            if take[i] < count[i] and size[i] <= left:
                take[i] += 1
                left -= int(size[i])
        for i in np.argsort(-size, kind="stable"):
            if left > EXACT_WORDS and size[i]:
                more = min(int(count[i] - take[i]), (left - EXACT_WORDS + int(size[i]) - 1) // int(size[i]), left // int(size[i]))
                take[i] += more
                left -= more * int(size[i])
        take += _knapsack(size, count - take, left, seed)
    out = np.zeros(len(size), np.int64)
    out[order] = take
    return out


def _knapsack(size: np.ndarray, count: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Bounded subset sum: bit s of `reached` tells whether some choice adds up to s."""
    take = np.zeros(len(size), np.int64)
    if budget <= 0:
        return take
    items = []
    for i in np.flatnonzero((count > 0) & (size > 0) & (size <= budget)):
        most, part = min(int(count[i]), budget // int(size[i])), 1
        while most > 0:
            n = min(part, most)
            items.append((int(i), n, n * int(size[i])))
            most, part = most - n, part * 2
    random.Random(seed).shuffle(items)
    full, reached, before = (1 << (budget + 1)) - 1, 1, []
    for _, _, weight in items:
        if reached >> budget & 1:
            break
        before.append(reached)
        reached |= reached << weight & full
    at = reached.bit_length() - 1
    for (i, n, weight), earlier in zip(items[len(before) - 1 :: -1] if before else [], reversed(before), strict=True):
        if not earlier >> at & 1:
            take[i] += n
            at -= weight
    return take


def _key() -> Column:
    """The source as a key that isn't null."""
    return F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, size, n, whole, extra): passes over all documents, and how many of n are taken once more."""
    of = targets.select(_key().alias("source_key"), "source_size", "target")
    with_target = tk.join_few(counts, of, ["source_key"], "size")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        # a row for each length of a source
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = int(target // total) if total else 0
        extra = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), round(target - whole * total), SEED)
        return pd.DataFrame({"source_key": group["source_key"], "size": group["size"], "n": group["n"], "whole": whole, "extra": extra})

    return with_target.groupBy("source_key").applyInPandas(fit, "source_key string, size long, n long, whole int, extra long")


def copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with `copies`, how often the mix takes each row."""
    own = ["doc_id", "text_hash"]
    rows = tk.join_few(sized, plan, ["source_key", "size"], "text_hash").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), *own), F.ceil(F.col("n") / BLOCK)))
    rows = tk.cut(rows.withColumn("h", F.xxhash64(F.lit(SEED), *own)))
    by_block = rows.groupBy("source_key", "size", "block").agg(F.count("*").alias("in_block"), F.first("extra").alias("all"))
    before = F.coalesce(F.sum("in_block").over(Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by_block.select("source_key", "size", "block", F.least(F.greatest(F.col("all") - before, F.lit(0)), F.col("in_block")).alias("quota"))
    joined = rows.join(quota, ["source_key", "size", "block"])
    place = F.row_number().over(Window.partitionBy("source_key", "size", "block").orderBy("h", *own))
    return joined.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + (place <= F.col("quota")).cast("int")).otherwise(0)).select(*sized.columns, "copies")


def plan_mix(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, source, source_key, size, copies) of every row, and the sources' targets."""
    sized = tk.cut(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("source"), _key().alias("source_key"), word_count(text).alias("size")))
    targets = source_targets(sized)
    counts = sized.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    return copies(sized, _plan(counts, targets)), targets


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of docs as often as the mix takes it."""
    taken, _ = plan_mix(docs, text)
    id_, hash_, key, size, all_, rows_, place, again = tk.fresh(docs, "_doc", "_text_hash", "_source_key", "_size", "_all", "_rows", "_same", "_again")
    own = [id_, hash_, key, size]
    picks = taken.groupBy("doc_id", "text_hash", "source_key", "size").agg(F.sum("copies").alias(all_), F.count("*").alias(rows_)).filter(F.col(all_) > 0)
    picks = picks.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("source_key").alias(key), F.col("size").alias(size), all_, rows_)
    rows = docs.select("*", F.xxhash64(text).alias(f"{hash_}_"), _key().alias(f"{key}_"), word_count(text).alias(f"{size}_"))
    on = rows["doc_id"].eqNullSafe(picks[id_])
    for k in (hash_, key, size):
        on &= rows[f"{k}_"] == picks[k]
    found = rows.join(picks, on)
    # rows alike share evenly; only what doesn't divide needs their order
    uneven = F.col(all_) % F.col(rows_) != 0
    order = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1)))
    even = found.filter(~uneven).withColumn(place, F.lit(0))
    times = F.floor(F.col(all_) / F.col(rows_)).cast("int")
    each = even.withColumn(again, times).unionByName(found.filter(uneven).withColumn(place, order).withColumn(again, times + (F.col(place) <= F.col(all_) % F.col(rows_)).cast("int")))
    return each.filter(F.col(again) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(again)))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    taken, targets = plan_mix(tk.table(spark, sf_dir, "documents"))
    out = tk.join_few(taken, targets.select(_key().alias("source_key"), "source_size", "target"), ["source_key"], "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
