"""PLY files as tables: a data source ``ply`` whose tasks read byte ranges, and a sink of parts with a commit.

Files are opened in ranges through Arrow's file systems (local paths, and the URIs that Arrow knows). No task reads
more of a file than its header and its own records, and a header alone tells schema and count.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skyloom.sources.ply import TYPES, header

#: Bytes of records that a task reads, about, and rows that are in memory at once.
SPLIT, ROWS = 128 << 20, 1 << 16
#: Bytes of a header at first, and at most.
HEAD, HEAD_MOST = 1 << 12, 1 << 24

_SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_ARROW = {T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64()}
_STORED = {T.ByteType(): "char", T.ShortType(): "short", T.IntegerType(): "int", T.FloatType(): "float", T.DoubleType(): "double"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[fs.FileInfo]:
    """The file, the PLY files of a folder (of its subfolders too), or those that a pattern in the last step fits; by name."""
    store, at = opened(path)
    folder, _, last = at.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder or "/")) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(".ply") and not any(s.startswith("_") for s in f.path[len(at) :].split("/"))]
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)


def head(file: pa.NativeFile) -> tuple[list[tuple[str, int, np.dtype]], list[str], int]:
    """``header`` of an open file, of which no more than that is read."""
    data = b""
    while b"end_header" not in data or not data.endswith(b"\n") and b"end_header\n" not in data and b"end_header\r\n" not in data:
        more = file.read(max(HEAD, len(data)))
        data += more
        if not more or len(data) > HEAD_MOST:
            break
    return header(data)


def element(found: list[tuple[str, int, np.dtype]], name: str, at: int) -> tuple[int, int, np.dtype]:
    """(place of the first record, records, record type) of an element; KeyError without it."""
    for n, count, kind in found:
        if n == name:
            return at, count, kind
        at += count * kind.itemsize
    raise KeyError(f"no element {name}")


def schema_of(kind: np.dtype) -> T.StructType:
    fields = [T.StructField(n, _SPARK[kind[n].str[1:]]) for n in kind.names or ()]
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("splat_id", T.LongType()), *fields])


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: a task reads the records that begin in them."""

    parts: list[tuple[str, int, int]]


class PlyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.name = schema, options["path"], options.get("element", "vertex")
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Ranges]:
        """Large files in ranges of ``split`` bytes, small ones together. Sizes are of the listing: no file is opened."""
        out, held, size = [], [], 0
        store = self.path if "://" in self.path else ""
        for f in listed(self.path):
            path = f"{store.split('://')[0]}://{f.path}" if store else f.path
            for start in range(0, max(1, f.size), self.split):
                stop = min(start + self.split, f.size)
                if held and size + stop - start > self.split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, start, stop))
                size += stop - start
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.parts:
            store, at = opened(path)
            with store.open_input_file(at) as f:
                found, _, end = head(f)
                try:
                    first, count, kind = element(found, self.name, end)
                except KeyError as e:
                    raise KeyError(f"{path}: {e.args[0]}") from None
                if missing := [c.name for c in self.schema if c.name not in ("path", "splat_id") and c.name not in (kind.names or ())]:
                    raise KeyError(f"{path}: missing columns {missing}")
                size = max(1, kind.itemsize)
                a, b = (min(count, max(0, -(-(x - first) // size))) for x in (start, stop))
                for row in range(a, b, ROWS):
                    n = min(ROWS, b - row)
                    f.seek(first + row * size)
                    data = f.read(n * size)
                    if len(data) < n * size:
                        raise ValueError(f"{path}: {self.name} ends after {row + len(data) // size} of {count} records")
                    yield self.batch(path, row, np.frombuffer(data, kind, n))

    def batch(self, path: str, row: int, records: np.ndarray) -> pa.RecordBatch:
        made = {"path": lambda: pa.array([path] * len(records), pa.string()), "splat_id": lambda: pa.array(np.arange(row, row + len(records)))}
        columns = [made[c.name]() if c.name in made else pa.array(np.ascontiguousarray(records[c.name])).cast(_ARROW[c.dataType]) for c in self.schema]
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class PlyWriter(DataSourceArrowWriter):
    """Each task writes one whole file to a folder of the job's own; the commit moves those that count to the target."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.fields = [(f.name, _STORED.get(f.dataType)) for f in schema]
        if bad := [n for n, kind in self.fields if kind is None]:
            raise TypeError(f"no PLY type for columns {bad}")
        self.target, self.overwrite, self.name = options["path"].rstrip("/"), overwrite, options.get("element", "vertex")
        self.comments = [f"comment color_space {options['color_space']}"] if "color_space" in options else []
        self.job = uuid.uuid4().hex
        self.staging = f"{self.target}/_staging-{self.job}"

    def head(self, rows: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", *self.comments, f"element {self.name} {rows}", *[f"property {kind} {n}" for n, kind in self.fields], "end_header"]
        return ("\n".join(lines) + "\n").encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """Records go to a body first, since a header states their number; nulls are written as zeros."""
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = opened(self.staging)
        store.create_dir(folder, recursive=True)
        base = posixpath.join(folder, f"{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}")
        kind, rows = np.dtype([(n, TYPES[t]) for n, t in self.fields]), 0
        with store.open_output_stream(f"{base}.body") as out:
            for b in iterator:
                records = np.zeros(b.num_rows, kind)
                for i, (n, _) in enumerate(self.fields):
                    records[n] = b.column(i).fill_null(0).to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
                rows += b.num_rows
        if rows:
            with store.open_input_stream(f"{base}.body") as body, store.open_output_stream(f"{base}.ply") as out:
                out.write(self.head(rows))
                while block := body.read(1 << 22):
                    out.write(block)
        store.delete_file(f"{base}.body")
        return Part(f"{base}.ply", rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Parts in the order of their tasks; an empty table is one part without records. Old parts go only now."""
        store, folder = opened(self.target)
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".ply")] if self.overwrite else []
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.path)
        for i, m in enumerate(parts):
            store.move(m.path, f"{folder}/part-{i:05d}-{self.job}.ply")
        if not parts:
            with store.open_output_stream(f"{folder}/part-00000-{self.job}.ply") as out:
                out.write(self.head(0))
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, staging = opened(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class PlySource(DataSource):
    """``spark.read.format("ply")``: path, splat_id (place in the file) and an element's properties; options element, split.

    A schema given by the caller prunes columns: only its properties are taken from the records.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no PLY file in {self.options['path']}")
        store, _ = opened(self.options["path"])
        with store.open_input_file(files[0].path) as f:
            found, _, at = head(f)
        return schema_of(element(found, self.options.get("element", "vertex"), at)[2])

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(schema, dict(self.options), overwrite)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, element: str = "vertex", split: int = SPLIT) -> DataFrame:
    """PLY files as a table with the given columns (all: None) of an element; KeyError for one that a file lacks."""
    spark.dataSource.register(PlySource)
    source = spark.read.format("ply").option("element", element).option("split", str(split))
    if columns is None:
        return source.load(path)
    known = {f.name: f for f in PlySource({"path": path, "element": element}).schema()}
    if missing := [c for c in columns if c not in known]:
        raise KeyError(f"{path}: missing columns {missing}")
    return source.schema(T.StructType([known[c] for c in columns])).load(path)


def save(table: DataFrame, folder: str, mode: str = "overwrite", **options: str) -> None:
    """The table as a folder of PLY files, one for each task with rows, in the order of the partitions."""
    table.sparkSession.dataSource.register(PlySource)
    table.write.format("ply").options(**options).mode(mode).save(folder)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, vertices, fields, elements, comments) of each file; only headers are read."""
    files = [f.path for f in listed(path)]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    rows = spark.createDataFrame([(scheme + f,) for f in files], "path string").repartition(max(1, min(len(files), 1000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                store, at = opened(p)
                with store.open_input_file(at) as f:
                    found, comments, _ = head(f)
                vertex = next(((k, list(t.names or ())) for n, k, t in found if n == "vertex"), (0, []))
                out.append({"path": p, "vertices": vertex[0], "fields": vertex[1], "elements": [n for n, _, _ in found], "comments": comments})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("vertices", pa.int64()), *[(c, pa.list_(pa.string())) for c in ("fields", "elements", "comments")]]))

    return rows.mapInArrow(run, "path string, vertices long, fields array<string>, elements array<string>, comments array<string>")


def ordered(table: DataFrame, by: str = "splat_id") -> DataFrame:
    """Rows dealt by range and sorted, so that the parts of ``save`` follow one another."""
    return table.repartitionByRange(by).sortWithinPartitions(by).drop(by)


def numbered(parts: DataFrame) -> DataFrame:
    """A folder's rows numbered through all its parts in ``splat_id``: places in a file plus the rows of those before."""
    from pyspark.sql import Window

    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = parts.groupBy("path").agg(F.count("*").alias("n"))
    start = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return parts.join(start, "path").withColumn("splat_id", F.col("splat_id") + F.col("start")).drop("start")
