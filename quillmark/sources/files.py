"""Reading and writing: crawled files, exported trees, catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.functions.scalars import suffix
from quillmark.storage import cut

MAX_TREE_DEPTH = 64


def name_pattern(exts: Sequence[str]) -> str:
    """A glob of the names with one of the extensions, in whatever case."""
    any_case = lambda c: f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else c
    return "*{" + ",".join("".join(map(any_case, e)) for e in exts) + "}"


def scan_files(spark: SparkSession, root: str, exts: Sequence[str]) -> DataFrame:
    """(key, path, checksum, size_bytes, modified_at, content) of all files below root with one of the extensions.

    The key is the path below root.  Order by key when order matters."""
    base = root.rstrip("/")
    # other files are passed over as they are listed, and so never opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_pattern(exts)).load(base)
    key = F.substring_index(F.col("path"), f"{base.split('://')[-1]}/", -1)
    out = files.select(key.alias("key"), "path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return out.filter(suffix(F.col("key")).isin([e.lower() for e in exts]))


def scan_files_after(files: DataFrame, key: str | None) -> DataFrame:
    return files if key is None else files.filter(F.col("key") > key)


def tree_reach(trees: DataFrame, depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """(up, down, path, depth): every tree below every tree, at most `depth` levels.  trees: up, down, path, depth (1).

    Lengths double: pairs up to 2**k levels apart are joined to those exactly 2**k apart, so there are as many
    rounds as the depth has binary digits, and a tree that stands in many places is expanded once."""
    reach = exact = trees
    length = 1
    while length < depth:
        step = reach.select(F.col("up").alias("down"), F.col("down").alias("_down"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        longer = exact.join(step, "down").select("up", F.col("_down").alias("down"), F.concat_ws("/", "path", "_path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"))
        longer = cut(longer.filter(F.col("depth") <= depth))
        if longer.isEmpty():
            break
        length *= 2
        reach, exact = reach.unionByName(longer), longer.filter(F.col("depth") == length)
    return reach


def expand_tree(entries: DataFrame, roots: DataFrame, depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """Entries with full paths: (root_tree_id, path, depth, object_id, mode, object_type, size_bytes).

    entries: parent_tree_id, name, object_id, mode, object_type, size_bytes; roots: root_tree_id.  Trees are expanded
    among themselves first; only then each root's trees meet all entries, in one join."""
    trees = cut(entries.filter("object_type = 'tree'").select(F.col("parent_tree_id").alias("up"), F.col("object_id").cast(entries.schema["parent_tree_id"].dataType).alias("down"), F.col("name").alias("path"), F.lit(1).alias("depth")))
    tops = roots.select("root_tree_id").distinct()
    below = tops.join(tree_reach(trees, depth - 1), F.col("root_tree_id") == F.col("up")).select("root_tree_id", F.col("down").alias("parent_tree_id"), F.concat("path", F.lit("/")).alias("_prefix"), F.col("depth").alias("_above"))
    front = below.unionByName(tops.select("root_tree_id", F.col("root_tree_id").alias("parent_tree_id"), F.lit("").alias("_prefix"), F.lit(0).alias("_above")))
    found = front.join(entries, "parent_tree_id")
    return found.select("root_tree_id", F.concat("_prefix", "name").alias("path"), (F.col("_above") + 1).alias("depth"), "object_id", "mode", "object_type", "size_bytes")


def load_table(spark: SparkSession, place: str, name: str, organization_id=None) -> DataFrame:
    """A catalogue table, all of it or one tenant's partition."""
    df = spark.read.parquet(f"{place}/{name}.parquet")
    return df if organization_id is None else df.filter(F.col("organization_id") == organization_id)


def replace_table(df: DataFrame, place: str, name: str) -> None:
    """Write a table's next snapshot; tenants that df doesn't hold keep their partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("organization_id").parquet(f"{place}/{name}.parquet")


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
