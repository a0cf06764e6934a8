"""Audits of whole tables: rules on rows, keys, references, vectors, JSON, trees and cursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quillmark.functions.scalars import collision_key
from quillmark.storage import cut

TREE_ENTRIES = 1000
# Keys and shapes that must not stand in stored metadata.
FORBIDDEN_KEYS = ("content", "raw_content", "chunk", "chunks", "chunk_text", "vector", "vectors", "embedding", "embeddings", "credential", "credentials", "token", "access_token", "refresh_token", "secret", "password", "path", "file_path", "traceback", "provider_response", "provider_payload")
_KEYS = r'(?:^|[^\\])"((?i:' + "|".join(FORBIDDEN_KEYS) + r'))"\s*:'
#: Shapes in any case, shapes as they are written, and strings that begin as absolute paths.
_VALUES = r'(?i:bearer |password=|secret=|api_key=)|-----BEGIN |Traceback \(most recent call last\)|[:\[,{]"(/|[A-Za-z]:(\\\\|/))|^"(/|[A-Za-z]:(\\\\|/))'


def check_rows(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n_rows, n_failed) of SQL conditions; as in databases, a condition that is null holds."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(F.expr(r), F.lit(True))).alias(f"r{i}") for i, r in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col("_n").alias("n_rows"), F.col(f"r{i}").alias("n_failed")) for i, name in enumerate(rules)])).alias("r")
    return counts.select(rows).select("r.*")


def check_unique(df: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    """The keys that more than one row has, among rows that `where` picks; rows with a null key don't count."""
    rows = df.filter(where) if where else df
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_references(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The child's rows whose keys (child column: parent column) the parent lacks; null keys refer to nothing."""
    there = parent.select(*[F.col(p).alias(c) for c, p in keys.items()]).distinct()
    return child.dropna(subset=list(keys)).join(there, list(keys), "left_anti")


def check_vectors(df: DataFrame, column: str, dimensions: int) -> DataFrame:
    """df with `fault`: a wrong dimension, a value that isn't finite, or null."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("fault", F.when(v.isNull(), None).when(F.size(v) != dimensions, "wrong_dimension").when(bad, "not_finite"))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with `fault`: blank, a length that isn't end - start, or an index that its document has twice."""
    n = F.count("*").over(Window.partitionBy("document_id", "chunk_index"))
    fault = F.when(F.btrim("content") == "", "blank").when(F.col("character_count") != F.col("end_offset") - F.col("start_offset"), "wrong_length").when(F.col("_n") > 1, "repeated_index")
    return chunks.withColumn("_n", n).withColumn("fault", fault).drop("_n")


def check_embedding_results(requests: DataFrame, results: DataFrame, dimensions: int, model: str) -> DataFrame:
    """(input_index, fault) of every input that isn't answered exactly once by a vector of the model and dimension."""
    got = results.groupBy("input_index").agg(F.count("*").alias("_n"), F.min(F.size("embedding")).alias("_low"), F.max(F.size("embedding")).alias("_high"), F.count_if(F.col("embedding_model") != model).alias("_other"))
    joined = requests.select("input_index").distinct().withColumn("_asked", F.lit(True)).join(got, "input_index", "full_outer")
    fault = F.when(F.col("_asked").isNull(), "not_asked").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when((F.col("_low") != dimensions) | (F.col("_high") != dimensions), "wrong_dimension").when(F.col("_other") > 0, "wrong_model")
    return joined.select("input_index", fault.alias("fault")).filter("fault is not null")


def scan_unsafe_json(df: DataFrame, column: str) -> DataFrame:
    """df with `unsafe`: its JSON has a forbidden key at any depth, or a string of a forbidden shape.

    The JSON is parsed and written again first, so blanks and escaped letters don't hide anything.  What isn't JSON is
    scanned as it stands."""
    c = F.coalesce(F.to_json(F.try_parse_json(F.col(column))), F.col(column), F.lit(""))
    return df.withColumn("unsafe", c.rlike(_KEYS) | c.rlike(_VALUES))


#: The shapes of a string by itself.
_SHAPES = r"(?i:bearer |password=|secret=|api_key=)|-----BEGIN |Traceback \(most recent call last\)|^(/|[A-Za-z]:(\\|/))"
MAX_JSON_DEPTH = 64


def json_faults(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, fault) of each forbidden key and each string of a forbidden shape, at any depth.

    Values are walked as variants, a level in each round; only objects and arrays go on to the next.  What isn't JSON has
    no path, and is `text` if `scan_unsafe_json` finds it unsafe."""
    spark = df.sparkSession
    parsed = df.select(F.col(key).alias("_row"), F.col(column).alias("_text"), F.try_parse_json(F.col(column)).alias("_v"))
    raw = scan_unsafe_json(parsed.filter("_v is null and _text is not null"), "_text").filter("unsafe").select("_row", F.lit(None).cast("string").alias("path"), F.lit("text").alias("fault"))
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    shape = lambda c: is_text(c) & F.try_variant_get(c, "$", "string").rlike(_SHAPES)
    out = raw.unionByName(parsed.filter(shape(F.col("_v"))).select("_row", F.lit("$").alias("path"), F.lit("value").alias("fault")))
    level = parsed.filter("_v is not null").select("_row", F.lit("$").alias("path"), F.to_json("_v").alias("_json"))
    for _ in range(MAX_JSON_DEPTH):
        nodes = level.withColumn("_v", F.parse_json("_json")).select("_row", "path", "_v")
        parts = nodes.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        at = F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key"))))
        names = F.when(F.lower("key").isin(*FORBIDDEN_KEYS), F.lit("key"))
        faults = F.array_compact(F.array(names, F.when(shape(F.col("value")), F.lit("value"))))
        kind = F.schema_of_variant("value")
        found = cut(parts.select("_row", at.alias("path"), faults.alias("faults"), F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json("value")).alias("_json")).filter("size(faults) > 0 or _json is not null"))
        out = out.unionByName(found.select("_row", "path", F.explode("faults").alias("fault")))
        level = found.filter("_json is not null").select("_row", "path", "_json")
        if level.isEmpty():
            break
    return out.withColumnRenamed("_row", key)


def check_tree(entries: DataFrame) -> DataFrame:
    """(parent_tree_id, n_entries, n_duplicates, n_collisions, accepted) of each tree page."""
    keyed = entries.withColumn("_key", collision_key("name"))
    by_name = keyed.groupBy("parent_tree_id", "_key").agg(F.count("*").alias("_n"), F.countDistinct("name").alias("_d"))
    out = by_name.groupBy("parent_tree_id").agg(F.sum("_n").cast("long").alias("n_entries"), F.sum(F.col("_n") - F.col("_d")).cast("long").alias("n_duplicates"), F.sum(F.col("_d") - 1).cast("long").alias("n_collisions"))
    return out.withColumn("accepted", (F.col("n_duplicates") == 0) & (F.col("n_collisions") == 0) & (F.col("n_entries") <= TREE_ENTRIES))


def check_cursor_history(cursors: DataFrame) -> DataFrame:
    """cursors with `fault`: a version that doesn't rise, a phase that goes back, or a total that falls."""
    w = Window.partitionBy("scope_id").orderBy("id")
    rank = F.array_position(F.array(F.lit("traversal"), F.lit("reconciliation"), F.lit("complete")), F.col("phase"))
    before = cursors.withColumn("_v", F.lag("cursor_version").over(w)).withColumn("_r", F.lag(rank).over(w)).withColumn("_t", F.lag("total").over(w))
    fault = F.when(F.col("cursor_version") <= F.col("_v"), "version").when(rank < F.col("_r"), "phase").when(F.col("total") < F.col("_t"), "total")
    return before.withColumn("fault", fault).drop("_v", "_r", "_t")
