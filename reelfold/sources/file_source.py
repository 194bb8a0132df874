"""Data sources for file bytes: planned byte ranges, and a writer that commits as one.

Spark's own file sources cut no binary file into ranges and commit no file of a caller's name. These two fill
that in; register them with :func:`register`. :func:`list_files` lists many files in tasks, those of 0 bytes
included, which Spark's sources leave out. A path without a scheme is of the local file system; names that start with ``_`` or ``.``
are not listed.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from reelfold.session import scratch_path

FILE_RANGES, FILE_PARTS = "reelfold_file_ranges", "reelfold_file_parts"
LISTED = "path string, modification_time timestamp, length bigint, content binary"
RANGED = "path string, chunk_no int, length bigint, data binary"
PARTED = "file_id string, part bigint, chunk_no int, data binary"
RANGE_BYTES = 64 * 1024 * 1024  # read by one task
LISTING_TASKS = 1000
FOLDERS_PER_TASK = 2000
FILES_PER_TASK = 20_000  # small files read by one task
_BATCH_BYTES = 4 * 1024 * 1024
_LISTED = pa.schema([
    ("path", pa.string()), ("modification_time", pa.timestamp("us", "UTC")), ("length", pa.int64()),
    ("content", pa.binary()),
])
_RANGED = pa.schema([("path", pa.string()), ("chunk_no", pa.int32()), ("length", pa.int64()), ("data", pa.binary())])


def register(spark: SparkSession) -> None:
    for source in (FileRanges, FileParts):
        spark.dataSource.register(source)


# --- listing ------------------------------------------------------------------------------------


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _named(uri: str, name: str) -> str:
    """A path of the file system in the form that Spark gives it."""
    place = re.match("[a-z0-9+.-]+://[^/]+", uri)
    return f"{place[0]}/{name.lstrip('/').removeprefix(place[0].split('://')[1]).lstrip('/')}" if place else f"file:{name}"


def _shown(base: str, name: str) -> bool:
    return not any(part[:1] in ("_", ".") for part in posixpath.relpath(name, base).split("/"))


def listed(uri: str, glob: str | None = None) -> Iterator[pafs.FileInfo]:
    """Files below ``uri``."""
    system, base = _opened(uri)
    for info in system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        if info.type == pafs.FileType.File and _shown(base, info.path):
            if not glob or fnmatch.fnmatchcase(info.base_name, glob):
                yield info


# --- listing in tasks ---------------------------------------------------------------------------


def _matches(glob: str) -> re.Pattern:
    """A file name pattern as Spark's ``pathGlobFilter`` reads it: ``* ? [a-z] [^a] {a,b}``, ``\\`` escapes."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^{body[1:]}]" if body[0] in "^!" else f"[{body}]"
            at = end
        elif c in "{}" or (c == "," and depth):
            depth += {"{": 1, "}": -1, ",": 0}[c]
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return re.compile(out, re.DOTALL)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name[:1] == "_" and "=" not in name) or name[:1] == "." or name.endswith("._COPYING_")


def list_files(spark: SparkSession, uri: str, glob: str | None = None) -> tuple[DataFrame, int]:
    """``path, modification_time, length`` of the files below ``uri`` as a stored table, and a number of
    tasks for reading them.

    One job a level of folders: its tasks list some folders each, alone, and write what they find. Folders
    and files stay in tables; the driver gets their counts.
    """
    name_of = _matches(glob) if glob else None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                infos = [i for i in system.get_file_info(pafs.FileSelector(folder)) if not _hidden(i.base_name)]
                yield from rows(infos)

    def rows(infos: list[pafs.FileInfo]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(infos), 10_000):
            found = []
            for i in infos[at : at + 10_000]:
                if i.type == pafs.FileType.Directory:
                    found.append((i.path, None, None))
                elif i.type == pafs.FileType.File and (name_of is None or name_of.fullmatch(i.base_name)):
                    found.append((_named(uri, i.path), i.mtime_ns // 1000, i.size))
            if found:
                path, time, size = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path), pa.array(time, pa.int64()).cast(_LISTED.field(1).type), pa.array(size, pa.int64())],
                    names=_LISTED.names[:3],
                )

    schema = LISTED.rsplit(",", 1)[0]
    system, base = _opened(uri)
    top = system.get_file_info(base)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such path: {uri}")
    out = scratch_path(spark, "listing")
    if top.type == pafs.FileType.File:
        found = [r for b in rows([top]) for r in b.to_pylist()]
        spark.createDataFrame(found, schema).coalesce(1).write.parquet(f"{out}/files/level=0")
        level, folders = None, 0
    else:
        level, folders = spark.createDataFrame([(base,)], "path string").coalesce(1), 1
    depth = 0
    while folders:
        seen = f"{out}/seen/level={depth}"
        level.mapInArrow(look, schema).write.parquet(seen)
        rows_seen = spark.read.schema(schema).parquet(seen)
        rows_seen.filter(F.col("length").isNotNull()).write.parquet(f"{out}/files/level={depth}")
        below = rows_seen.filter(F.col("length").isNull()).select("path")
        folders, depth = below.count(), depth + 1
        spread = max(min(folders, LISTING_TASKS // 5), -(-folders // FOLDERS_PER_TASK))
        level = below.repartition(max(1, min(LISTING_TASKS, spread)))
    files = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/files")
    count, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    return files, max(1, -(-count // FILES_PER_TASK), -(-(size or 0) // RANGE_BYTES))


def contents(uri: str) -> Column:
    """The bytes of the files below ``uri`` whose ``path`` and ``length`` :func:`list_files` gave; a few
    megabytes of small files, or one large file, are held at a time."""

    @F.arrow_udf("binary")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        system, base = _opened(uri)
        before = len(_named(uri, base)) - len(base)
        for names, sizes in batches:
            held, size = [], 0
            for name, length in zip(names.to_pylist(), sizes.to_pylist()):
                data = b""
                if length:
                    with system.open_input_file(name[before:]) as source:
                        data = source.read()
                held.append(data)
                size += len(data)
                if size >= _BATCH_BYTES:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            yield pa.array(held, pa.binary())

    return read("path", "length")


# --- byte ranges --------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last, length of the file) that one task reads."""

    pieces: list[tuple[str, int, int, int]]


class FileRanges(DataSource):
    """Chunks of ``chunk_bytes`` of the files below ``path``.

    A task gets contiguous ranges of about ``range_bytes``: a part of one file or several small files,
    each opened once and read from its first byte on. With ``keep_empty`` an empty file has one empty
    chunk, without it none.
    """

    @classmethod
    def name(cls) -> str:
        return FILE_RANGES

    def schema(self) -> str:
        return RANGED

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.glob = options["path"], options.get("glob")
        self.chunk = int(options["chunk_bytes"])
        self.keep_empty = options.get("keep_empty", "false").lower() == "true"
        # whole chunks in every range
        self.range = max(1, int(options.get("range_bytes", RANGE_BYTES)) // self.chunk) * self.chunk

    def partitions(self) -> list[Ranges]:
        plans, pieces, held = [], [], 0
        for info in sorted(listed(self.uri, self.glob), key=lambda i: i.path):
            starts = range(0, info.size, self.range) if info.size else range(1 if self.keep_empty else 0)
            for start in starts:
                end = min(info.size, start + self.range)
                if pieces and held + end - start > self.range:
                    plans.append(Ranges(pieces))
                    pieces, held = [], 0
                pieces.append((info.path, start, end, info.size))
                held += end - start
        return [*plans, Ranges(pieces)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.uri)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGED)], schema=_RANGED
            )

        for path, start, end, length in partition.pieces:
            name = _named(self.uri, path)
            if start == end:
                rows.append((name, 0, length, b""))
                continue
            with system.open_input_file(path) as source:
                source.seek(start)
                for at in range(start, end, self.chunk):
                    data = source.read(min(self.chunk, end - at))
                    rows.append((name, at // self.chunk, length, data))
                    held += len(data)
                    if held >= _BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


# --- parts with a commit ------------------------------------------------------------------------


@dataclass
class TaskFiles(WriterCommitMessage):
    """The folder and the manifest that a task has written."""

    name: str


class FileParts(DataSource):
    """Writes ``PARTED`` rows, sorted by file, part and chunk, to files below ``path``.

    Tasks write to a hidden folder of their own attempt. When all are done the driver moves those of the
    tasks that Spark committed together and shows them by one rename, ``run-<run>``; then the list of
    files, ``_files/run-<run>``, appears. A failed job leaves nothing that is listed. With ``parts`` a file
    is a folder of numbered parts, which different tasks may have written, without it one file.
    """

    @classmethod
    def name(cls) -> str:
        return FILE_PARTS

    def schema(self) -> str:
        return PARTED

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PartWriter(self.options)


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.uri, self.run = options["path"], options["run"]
        self.parts = options.get("parts", "true").lower() == "true"

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        system, base = _opened(self.uri)
        return system, base, posixpath.join(base, f".staging-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        system, _, staging = self._places()
        name = f"task-{uuid.uuid4().hex}"
        folder = posixpath.join(staging, "attempts", name)
        manifest, current, sink, pending, size = [], None, None, None, 0

        def flush() -> None:
            nonlocal size
            if pending is not None:
                sink.write(pending[1])
                size += len(pending[1])

        def finish() -> None:
            flush()
            sink.close()
            manifest.append({"file_id": current[0], "part": current[1], "path": where(*current), "length": size})

        def where(file_id: str, part: int) -> str:
            return f"{name}/{file_id}/part-{part:08d}" if self.parts else f"{name}/{file_id}"

        for batch in iterator:
            for file_id, part, number, data in zip(*(batch.column(c) for c in ("file_id", "part", "chunk_no", "data"))):
                group, chunk = (file_id.as_py(), part.as_py()), (number.as_py(), data.as_buffer() or b"")
                if group != current:
                    if current is not None:
                        finish()
                    current, pending, size = group, None, 0
                    target = posixpath.join(staging, "attempts", where(*group))
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    sink = system.open_output_stream(target)
                if pending is not None and pending[0] == chunk[0]:
                    # sent again: the bytes it already has, the larger ones if they differ
                    pending = max(pending, chunk, key=lambda c: bytes(c[1]))
                    continue
                flush()
                pending = chunk
        if current is not None:
            finish()
        if manifest:
            lists = posixpath.join(staging, "lists")
            system.create_dir(lists, recursive=True)
            with system.open_output_stream(posixpath.join(lists, f"{name}.json")) as out:
                out.write("".join(json.dumps(m) + "\n" for m in manifest).encode())
        return TaskFiles(name if manifest else "")

    def commit(self, messages: list[TaskFiles | None]) -> None:
        system, base, staging = self._places()
        for kind, target in (("attempts", f"run-{self.run}"), ("lists", f"_files/run-{self.run}")):
            ready = posixpath.join(staging, f"ready-{kind}")
            system.create_dir(ready, recursive=True)
            for message in messages:
                if message is not None and message.name:
                    one = message.name + (".json" if kind == "lists" else "")
                    system.move(posixpath.join(staging, kind, one), posixpath.join(ready, one))
            system.create_dir(posixpath.dirname(posixpath.join(base, target)), recursive=True)
            system.move(ready, posixpath.join(base, target))
        system.delete_dir(staging)

    def abort(self, messages: list[TaskFiles | None]) -> None:
        system, _, staging = self._places()
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)
