"""A folder of files as a Spark data source: rows in key order, dealt by ranges of keys, in batch and as a stream.

    crawl.register(spark)
    spark.read.format("quillmark_files").option("extensions", ".md,.txt").load("/docs")
    spark.readStream.format("quillmark_files").load("/docs")

The key is the path below the folder, and keys are in the order of their code points.  A partition is a range of
keys; a task walks only the folders that may hold some of it, so nobody lists files for others.  Conditions on the
key (beyond a key, a prefix, an ending) are pushed into the walk.

A stream's offset is the last key that it has seen, as in a crawl that goes on behind its cursor: a restart goes on
there, and a file whose key is not behind the offset is left to the next crawl.  Symbolic links are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

SCHEMA = "key string, path string, checksum string, size_bytes long, modified_at timestamp, content binary"
#: Files in a partition, and bytes of content in an Arrow batch.
FILES, BATCH_BYTES = 1000, 16 << 20
#: Behind every key.
_END = "\U0010ffff"


@dataclass
class Range(InputPartition):
    """Keys above `after` up to `last`."""

    after: str
    last: str

    def may_hold(self, folder: str) -> bool:
        """Whether keys below the folder (its own key with a slash) can lie in the range."""
        return folder + _END > self.after and folder <= self.last


@dataclass(frozen=True)
class Folder:
    root: str
    extensions: tuple[str, ...]

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)

    def walk(self, span: Range) -> Iterator[tuple[str, pafs.FileInfo]]:
        """(key, file) of a range in key order."""
        files, root = self._open()
        root = root.rstrip("/")
        local = isinstance(files, pafs.LocalFileSystem)

        def below(prefix: str) -> Iterator[tuple[str, pafs.FileInfo]]:
            found = files.get_file_info(pafs.FileSelector(f"{root}/{prefix}"))
            # a folder's keys stand where its name with a slash does
            for x in sorted(found, key=lambda x: x.base_name + "/" * (x.type == pafs.FileType.Directory)):
                key = prefix + x.base_name
                if local and _is_link(x.path):
                    continue
                if x.type == pafs.FileType.Directory:
                    if span.may_hold(key + "/"):
                        yield from below(key + "/")
                elif x.type == pafs.FileType.File and span.after < key <= span.last and (not self.extensions or key.lower().endswith(self.extensions)):
                    yield key, x

        yield from below("")

    def ranges(self, span: Range, size: int = FILES) -> list[Range]:
        """The span in ranges of `size` files."""
        out, after, n, key = [], span.after, 0, span.after
        for key, _ in self.walk(span):
            n += 1
            if n == size:
                out.append(Range(after, key))
                after, n = key, 0
        return [*out, Range(after, key)] if n else out

    def last_key(self, span: Range) -> str:
        key = span.after
        for key, _ in self.walk(span):
            pass
        return key

    def rows(self, span: Range, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        held, size = [], 0
        for key, x in self.walk(span):
            with files.open_input_stream(x.path) as stream:
                content = stream.read()
            held.append((key, x.path, hashlib.sha256(content).hexdigest(), len(content), x.mtime.astimezone(timezone.utc), content))
            size += len(content)
            if size > BATCH_BYTES:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)


def _is_link(path: str) -> bool:
    import os

    return os.path.islink(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_ARROW = pa.schema([("key", pa.string()), ("path", pa.string()), ("checksum", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("content", pa.binary())])


class FolderReader(DataSourceReader):
    def __init__(self, folder: Folder, size: int) -> None:
        self.folder, self.size, self.span = folder, size, Range("", _END)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what narrows the range or names an ending; Spark checks what is yielded."""
        after, last, endings = self.span.after, self.span.last, self.folder.extensions
        for f in filters:
            name = getattr(f, "attribute", None)
            if name != ("key",):
                yield f
            elif isinstance(f, GreaterThan):
                after = max(after, f.value)
            elif isinstance(f, LessThanOrEqual):
                last = min(last, f.value)
            elif isinstance(f, StringEndsWith):
                endings = (f.value.lower(),) if not endings else endings
                yield f  # the walk doesn't tell capitals
            elif isinstance(f, (GreaterThanOrEqual, LessThan, EqualTo, StringStartsWith)):
                low = f.value[:-1] + chr(ord(f.value[-1]) - 1) + _END if f.value and not isinstance(f, LessThan) else ""
                after = max(after, low)
                if isinstance(f, (LessThan, EqualTo)):
                    last = min(last, f.value)
                elif isinstance(f, StringStartsWith):
                    last = min(last, f.value + _END)
                yield f  # the range is a little wider
            else:
                yield f
        self.span, self.folder = Range(after, last), Folder(self.folder.root, endings)

    def partitions(self) -> list[Range]:
        return self.folder.ranges(self.span, self.size) or [Range(_END, _END)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition, _ARROW)


class FolderStream(DataSourceStreamReader):
    def __init__(self, folder: Folder, size: int) -> None:
        self.folder, self.size, self.seen = folder, size, ""

    def initialOffset(self) -> dict:
        return {"key": ""}

    def latestOffset(self) -> dict:
        self.seen = self.folder.last_key(Range(self.seen, _END))
        return {"key": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.folder.ranges(Range(start["key"], end["key"]), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition, _ARROW)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["key"])


class FolderSource(DataSource):
    """Options: path; extensions, comma-separated; filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_files"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> tuple[Folder, int]:
        endings = tuple(x.strip().lower() for x in self.options.get("extensions", "").split(",") if x.strip())
        return Folder(self.options["path"], endings), int(self.options.get("filesPerPartition", FILES))

    def reader(self, schema) -> FolderReader:
        return FolderReader(*self._folder())

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(*self._folder())


def register(spark: SparkSession) -> None:
    """Make the source known to the session; readers that take conditions need the setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
