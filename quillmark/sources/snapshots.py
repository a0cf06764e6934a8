"""Catalogue tables as committed snapshots: data by bucket and tenant, and a manifest that is written last.

A row's bucket is a hash of its table's key.  What a commit writes goes to a folder of its own, and only for the
buckets that it touches; then one manifest says, for all tables, in which folder each bucket is.  Readers follow the
manifest of the highest number that is whole, so a writer that is killed leaves the tables as they were, and tables
that are committed together change together.  A bucket is parted by tenant, so a tenant's rows are read alone.

Beside each bucket stand digests of its rows in two levels, a bucket and its LEAVES: how many rows there are, and
the sum and exclusive or of two hashes of them.  `changed` compares them with those of other rows of the same keys, so only
parts that differ need to be read and joined.

One writer at a time is assumed, as elsewhere in this package.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from quillmark.storage import cut, few

BUCKETS, LEAVES = 64, 64
#: The most leaves that are named in a filter; more are joined.
NAMED_LEAVES = 1000
_DIGEST = "bucket int, leaf int, n long, total decimal(38,0), mixed long"
_TENANT = "organization_id"


def upsert_snapshot(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of incoming in place of those with equal keys; columns that incoming lacks are kept."""
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns], F.lit(True).alias("_is_new"))
    on = [current[k].eqNullSafe(new[f"_new_{k}"]) for k in keys]
    joined = current.join(new, on, "full_outer")
    values = [F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(current[c]).alias(c) if c in incoming.columns else current[c] for c in current.columns]
    return joined.select(*values)


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), [rows[k].eqNullSafe(gone[k]) for k in keys], "left_anti")


@dataclass(frozen=True)
class Bucket:
    """A bucket of a table in a manifest; folder is empty if it has no rows."""

    table: str
    bucket: int
    folder: str
    n: int = 0
    total: str = "0"
    mixed: int = 0


@dataclass(frozen=True)
class Table:
    """What a manifest says of a table: its key, the columns whose values its digests see, and the schema as JSON."""

    name: str
    keys: list[str]
    seen: list[str]
    schema: str
    buckets: int


@dataclass(frozen=True)
class Staged:
    """Written data that no manifest names yet."""

    table: Table
    buckets: list[Bucket]


class Catalogue:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # the folder

    def _files(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _listed(self, place: str) -> list:
        files, path = self._files(place)
        return list(files.listStatus(path)) if files.exists(path) else []

    def _numbers(self, whole: bool) -> list[int]:
        found = [int(s.getPath().getName()) for s in self._listed("snapshots") if s.getPath().getName().isdigit()]
        return sorted(n for n in found if not whole or (lambda files, path: files.exists(path))(*self._files(f"snapshots/{n}/_SUCCESS")))

    def numbers(self) -> list[int]:
        """The committed snapshots, oldest first."""
        return self._numbers(whole=True)

    def manifest(self, number: int | None = None) -> dict[str, tuple[Table, dict[int, Bucket]]]:
        """Of a snapshot, or of the newest: each table with its buckets.  A row for each bucket, whatever the rows."""
        known = self.numbers()
        if not known:
            return {}
        rows = self.spark.read.schema("table string, body string").json(f"{self.root}/snapshots/{known[-1] if number is None else number}").collect()
        tables = {r["table"]: Table(**json.loads(r["body"])["of"]) for r in rows if "of" in json.loads(r["body"])}
        out = {name: (t, {}) for name, t in tables.items()}
        for r in rows:
            body = json.loads(r["body"])
            if "of" not in body:
                out[r["table"]][1][body["bucket"]] = Bucket(**body)
        return out

    # reading

    def read(self, name: str, number: int | None = None, organization_id=None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a snapshot: all of it, a tenant's rows, or some buckets."""
        table, held = self.manifest(number)[name]
        rows = self._read(table, [b for b in held.values() if buckets is None or b.bucket in set(buckets)])
        rows = rows.drop("_bucket", "_leaf")
        return rows if organization_id is None else rows.filter(F.col(_TENANT) == organization_id)

    def _read(self, table: Table, buckets: list[Bucket]) -> DataFrame:
        schema = StructType.fromJson(json.loads(table.schema))
        whole = StructType([*schema.fields]).add("_leaf", IntegerType()).add("_bucket", IntegerType())
        places = [f"{self.root}/data/{b.folder}/rows/_bucket={b.bucket}" for b in buckets if b.folder]
        if not places:
            return self.spark.createDataFrame([], whole)
        # folders of one writing share a base path, from which bucket and tenant are read
        out = None
        for folder in sorted({b.folder for b in buckets if b.folder}):
            own = [p for p in places if f"/data/{folder}/rows/" in p]
            part = self.spark.read.schema(whole).option("basePath", f"{self.root}/data/{folder}/rows").parquet(*own).select(whole.names)
            out = part if out is None else out.unionByName(part)
        return out

    # writing

    def _placed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        own = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
        return df.withColumn("_bucket", F.pmod(own, F.lit(buckets)).cast("int")).withColumn("_leaf", F.pmod(F.shiftright(own, 32), F.lit(LEAVES)).cast("int"))

    @staticmethod
    def _digests(placed: DataFrame, columns: list[str]) -> DataFrame:
        plain = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
        seen = placed.groupBy(F.col("_bucket").alias("bucket"), F.col("_leaf").alias("leaf"))
        return seen.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*plain).cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor(F.xxhash64(F.lit("x"), *plain)).alias("mixed"))

    def _write(self, table: Table, rows: DataFrame, touched: list[int]) -> Staged:
        """rows (with _bucket and _leaf), which are all of the touched buckets."""
        folder = f"{table.name}-{uuid.uuid4().hex}"
        parts = ["_bucket", _TENANT] if _TENANT in rows.columns else ["_bucket"]
        # sizes of buckets differ by their rows only; Spark merges small and splits large ones
        rows.hint("rebalance", "_bucket").sortWithinPartitions(*parts, "_leaf").write.partitionBy(*parts).parquet(f"{self.root}/data/{folder}/rows")
        schema = StructType([*StructType.fromJson(json.loads(table.schema)).fields]).add("_leaf", IntegerType()).add("_bucket", IntegerType())
        written = self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}/rows")
        leaves = f"{self.root}/data/{folder}/leaves"
        self._digests(written, [*table.keys, *table.seen]).coalesce(1).write.parquet(leaves)
        sums = self.spark.read.schema(_DIGEST).parquet(leaves).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))
        found = {r["bucket"]: r for r in sums.collect()}  # a row for each bucket
        full = lambda r: Bucket(table.name, r["bucket"], folder, r["n"], str(r["total"]), r["mixed"])
        return Staged(table, [full(found[b]) if b in found else Bucket(table.name, b, "") for b in touched])

    def stage(self, name: str, df: DataFrame, keys: list[str], seen: list[str] | None = None, buckets: int = BUCKETS) -> Staged:
        """A whole table.  seen: the columns that digests see beside the key; all others if it isn't given."""
        others = [c for c in df.columns if c not in keys]
        table = Table(name, list(keys), others if seen is None else list(seen), df.schema.json(), buckets)
        return self._write(table, self._placed(df, table.keys, buckets), list(range(buckets)))

    def stage_upsert(self, name: str, incoming: DataFrame, deleted: DataFrame | None = None) -> Staged:
        """The buckets of a table that incoming touches, with its rows in place of those of equal keys, without the keys of `deleted`."""
        table, held = self.manifest()[name]
        new = self._placed(incoming, table.keys, table.buckets)
        gone = None if deleted is None else self._placed(deleted.select(*table.keys).distinct(), table.keys, table.buckets)
        met = new.select("_bucket") if gone is None else new.select("_bucket").unionByName(gone.select("_bucket"))
        touched = sorted(r["_bucket"] for r in met.distinct().collect())  # at most all buckets
        old = self._read(table, [held[b] for b in touched])
        rows = upsert_snapshot(old, new, table.keys)
        return self._write(table, rows if gone is None else _without(rows, gone, table.keys), touched)

    def stage_groups(self, name: str, incoming: DataFrame, touched: DataFrame) -> Staged:
        """The same where many rows have a key: all rows of the keys of `touched` go, and incoming's come."""
        table, held = self.manifest()[name]
        gone = self._placed(touched.select(*table.keys).distinct(), table.keys, table.buckets)
        new = self._placed(incoming, table.keys, table.buckets)
        some = sorted(r["_bucket"] for r in gone.select("_bucket").unionByName(new.select("_bucket")).distinct().collect())
        old = self._read(table, [held[b] for b in some])
        return self._write(table, _without(old, gone, table.keys).unionByName(new.select(*old.columns)), some)

    def commit(self, *staged: Staged) -> int:
        """Make what was staged the next snapshot, all of it at once; the number of it."""
        tables = self.manifest()
        for s in staged:
            held = tables.get(s.table.name, (None, {}))[1] if len(s.buckets) < s.table.buckets else {}
            tables[s.table.name] = s.table, held | {b.bucket: b for b in s.buckets}
        rows = [(name, json.dumps({"of": asdict(t)})) for name, (t, _) in tables.items()] + [(name, json.dumps(asdict(b))) for name, (_, held) in tables.items() for b in held.values()]
        number = max(self._numbers(whole=False), default=0) + 1
        self.spark.createDataFrame(rows, "table string, body string").coalesce(1).write.mode("errorifexists").json(f"{self.root}/snapshots/{number}")
        return number

    def replace(self, name: str, df: DataFrame, keys: list[str], seen: list[str] | None = None, buckets: int = BUCKETS) -> int:
        return self.commit(self.stage(name, df, keys, seen, buckets))

    def upsert(self, name: str, incoming: DataFrame, deleted: DataFrame | None = None) -> int:
        return self.commit(self.stage_upsert(name, incoming, deleted))

    def expire(self, keep_seconds: float) -> list[str]:
        """Drop snapshots that were followed by another one before keep_seconds ago, and data of that age that none is left to name."""
        limit = (time.time() - keep_seconds) * 1000
        at = {int(s.getPath().getName()): s.getModificationTime() for s in self._listed("snapshots") if s.getPath().getName().isdigit()}
        known = self.numbers()
        old = [a for a, b in zip(known[:-1], known[1:], strict=True) if at[b] < limit]
        named = {b.folder for n in known if n not in old for _, held in self.manifest(n).values() for b in held.values()}
        broken = [n for n in at if n not in known and at[n] < limit]
        gone = [f"snapshots/{n}" for n in [*old, *broken]]
        gone += [f"data/{s.getPath().getName()}" for s in self._listed("data") if s.getPath().getName() not in named and s.getModificationTime() < limit]
        for place in gone:
            files, path = self._files(place)
            files.delete(path, True)
        return gone

    # comparing

    def changed(self, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows in parts that are equal to the table's, rows in parts that differ, the table's rows in these parts).

        rows: the table's key and the columns that its digests see, as many as it has.  Only folders of buckets that
        differ are read, and in them the leaves that do; leaves are in order there, so their row groups are told apart.
        """
        table, held = self.manifest()[name]
        columns = [*table.keys, *table.seen]
        placed = cut(self._placed(rows, table.keys, table.buckets))
        own = cut(self._digests(placed, columns))
        sums = {r["bucket"]: (r["n"], str(r["total"]), r["mixed"]) for r in own.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")).collect()}
        differ = [b for b in held.values() if sums.get(b.bucket, (0, "0", 0)) != (b.n, b.total, b.mixed)]
        if not differ:
            return placed.drop("_bucket", "_leaf"), placed.limit(0).drop("_bucket", "_leaf"), self._read(table, []).drop("_bucket", "_leaf")
        known = self.spark.createDataFrame([], _DIGEST)
        for folder in sorted({b.folder for b in differ if b.folder}):
            some = [b.bucket for b in differ if b.folder == folder]
            known = known.unionByName(self.spark.read.schema(_DIGEST).parquet(f"{self.root}/data/{folder}/leaves").filter(F.col("bucket").isin(some)))
        at = ["bucket", "leaf"]
        here = own.filter(F.col("bucket").isin([b.bucket for b in differ])).select(*at, *[F.col(c).alias(f"_{c}") for c in ("n", "total", "mixed")])
        same = F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total")) & F.col("mixed").eqNullSafe(F.col("_mixed"))
        leaves = cut(known.join(here, at, "full_outer").filter(~same).select(F.col("bucket").alias("_bucket"), F.col("leaf").alias("_leaf")))
        on = ["_bucket", "_leaf"]
        old = self._read(table, differ)
        if leaves.count() <= NAMED_LEAVES:  # a filter that reaches the files
            old = old.filter(F.col("_leaf").isin(sorted({r["_leaf"] for r in leaves.select("_leaf").distinct().collect()})))
        old = old.join(few(leaves), on, "left_semi")
        return placed.join(few(leaves), on, "left_anti").drop(*on), placed.join(few(leaves), on, "left_semi").drop(*on), old.drop(*on)

