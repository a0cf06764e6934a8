"""The folder that all executors share, and lineage cut through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a new folder where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quillmark-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet in the shared folder and read again: a lost executor loses nothing of it."""
    place = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: The most rows of a side that is broadcast.
BROADCAST_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are few enough, whatever its data; else as it is, for a shuffled join."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


#: Rows that a cell of `paired` makes about, and a task.
CELL_PAIRS, TASK_PAIRS = 4_000_000, 16_000_000
#: The most tasks of `paired` and `crossed`.
PAIR_TASKS = 2_000
#: The most cells that `crossed` makes for a task, besides one for each row.
TASK_CELLS = 4
#: The most keys in an array of `packed`, of the side whose keys stay and of the one that is run through for each of them.
OUTER_KEYS, INNER_KEYS = 128, 1_024
#: About the most keys that `packed` gathers in one list before it is cut into arrays.
PACKED_KEYS = 200_000


def paired(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, n_left: DataFrame | None = None) -> DataFrame:
    """left and right joined on `on`, of which one value may stand for many rows of both sides.

    Such a value's rows are dealt over a grid by hashes of left_key and right_key; each row of left meets each row of
    right in one cell.  Tasks are as many as the pairs ask for, which the size of the sides doesn't tell.  The sides are
    read twice, so they should be written ones; n_left (on, _nl) are the rows of left by value, if known without it.
    """
    n_left = left.groupBy(*on).agg(F.count("*").alias("_nl")) if n_left is None else n_left
    sizes = cut(n_left.join(right.groupBy(*on).agg(F.count("*").alias("_nr")), on).withColumn("_pairs", F.col("_nl").cast("double") * F.col("_nr")))
    total = sizes.agg(F.sum("_pairs")).first()[0] or 0
    if total <= TASK_PAIRS:
        return left.join(right, on)
    cells = F.ceil(F.col("_pairs") / CELL_PAIRS)
    sizes = sizes.withColumn("_na", F.least("_nl", F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_nl") / F.col("_nr"))))))
    sizes = few(sizes.withColumn("_nb", F.least("_nr", F.ceil(cells / F.col("_na")))).select(*on, "_na", "_nb"))
    tasks = int(min(max(total / TASK_PAIRS, float(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), PAIR_TASKS))
    at = [*on, "_a", "_b"]
    place = lambda key, n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # a stated number of parts isn't merged, however small their inputs are
    a = left.join(sizes, on).withColumn("_a", place(left_key, "_na")).withColumn("_b", every("_nb")).drop("_na", "_nb").repartition(tasks, *at)
    b = right.join(sizes, on).withColumn("_b", place(right_key, "_nb")).withColumn("_a", every("_na")).drop("_na", "_nb").repartition(tasks, *at)
    return a.join(b, at).drop("_a", "_b")


def packed(df: DataFrame, on: list[str], key: str, most: int) -> DataFrame:
    """(on, _p, key): df's keys of each value of `on` as arrays of at most `most`, told apart by _p; written.

    df is read twice, so it should be a written one.
    """
    parts = df.count() // PACKED_KEYS + 1
    whole = F.transform(F.collect_list(F.struct(key)), lambda x: x[key])  # a list of bare keys would leave out nulls
    lists = df.groupBy(*on, F.pmod(F.xxhash64(key), F.lit(parts)).alias("_p")).agg(whole.alias(key))
    slices = F.transform(F.sequence(F.lit(1), F.size(key), F.lit(most)), lambda at: F.slice(key, at, most))
    return cut(lists.select(*on, "_p", F.posexplode(slices).alias("_s", key)).select(*on, (F.col("_s") * parts + F.col("_p")).alias("_p"), key))


def crossed(rows: DataFrame, left: DataFrame, right: DataFrame, on_left: list[str], on_right: list[str], left_key: str, right_key: str) -> DataFrame:
    """Each row of rows with each pair of a key that left has for its on_left and one that right has for its on_right.

    left and right are `packed`, and only their arrays travel: over a grid of cells as in `paired`.  Above a number of
    pairs cells grow in place of their number, so that what is shuffled grows no faster than both sides.  Pairs come into
    being in the very last step and are never held, but for those of two arrays.
    """
    spark, columns = rows.sparkSession, rows.columns
    number = lambda df, on, key, n: df.groupBy(*on).agg(F.sum(F.size(key)).alias(f"_n{n}"), F.count("*").alias(f"_p{n}"))
    sized = rows.join(number(left, on_left, left_key, "l"), on_left).join(number(right, on_right, right_key, "r"), on_right)
    sized = cut(sized.withColumn("_pairs", F.col("_nl").cast("double") * F.col("_nr")).withColumn("_row", F.monotonically_increasing_id()))
    n_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()
    tasks = int(min(max(total / TASK_PAIRS, float(spark.conf.get("spark.sql.shuffle.partitions"))), PAIR_TASKS))
    cells = F.ceil(F.col("_pairs") / max(CELL_PAIRS, total / (PAIR_TASKS * TASK_CELLS)))
    sized = sized.withColumn("_na", F.least("_pl", F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_nl") / F.col("_nr"))))))
    sized = sized.withColumn("_nb", F.least("_pr", F.ceil(cells / F.col("_na"))))

    def dealt(side: DataFrame, on: list[str], own: str, other: str, kept: list[str]) -> DataFrame:
        some = sized.select(*dict.fromkeys([*on, *kept, "_row", "_na", "_nb"]))
        met = F.broadcast(some).join(side, on) if n_rows <= BROADCAST_ROWS else paired(some, side, on, "_row", "_p")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        return met.withColumn(f"_{own}", F.pmod("_p", f"_n{own}")).select(*kept, "_row", f"_{own}", every, side.columns[-1]).repartition(tasks, "_row", "_a", "_b")

    met = dealt(left, on_left, "a", "b", columns).join(dealt(right, on_right, "b", "a", []), ["_row", "_a", "_b"])
    # a step that isn't compiled into one with the join: that would hold all pairs of an array with the whole other side of its cell
    met = met.select(*columns, left_key, right_key).coalesce(2 * tasks)
    return met.select(*columns, F.explode(left_key).alias(left_key), right_key).select(*columns, left_key, F.explode(right_key).alias(right_key))
