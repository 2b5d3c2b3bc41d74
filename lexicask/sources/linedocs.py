"""Binary line documents: chunks of length-prefixed records, read in parallel with exact document numbers.

A file is a series of chunks: documents (int32), payload length (int32), payload. A record in a payload is the byte lengths of
title, body and label (int32 each), seconds of the day (int32), milliseconds since 1970 (int64), then the three UTF-8 strings.
A path is a file, a folder (its files in the order of their names; names that begin with _ or . are passed over) or a pattern with
* and ?; documents are numbered through all of its files. The driver walks chunk headers only, of many files at once; each task
reads whole chunks and hands on Arrow batches. Damaged files raise FormatError: a cut header, payload or record, a negative
length, or bytes that are not UTF-8. Chunks without documents are passed over, and bytes of a payload after its last record are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatchcase
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexicask.schema import LINE_DOCS

ORDERS = {"little": "<", "big": ">"}


class FormatError(ValueError):
    """A file that is not a whole line-documents file."""


def chunk_headers(file: BinaryIO, order: str = "little") -> Iterator[tuple[int, int, int]]:
    """Payload offset, payload length and documents of each chunk, by seeking from header to header."""
    head = struct.Struct(ORDERS[order] + "ii")
    size = file.seek(0, 2)
    at = 0
    while at < size:
        file.seek(at)
        raw = file.read(head.size)
        if len(raw) < head.size:
            raise FormatError("the file ends within a chunk header")
        docs, length = head.unpack(raw)
        if docs < 0 or length < 0:
            raise FormatError("negative length in a chunk header")
        if at + head.size + length > size:
            raise FormatError("the file ends within a payload")
        yield at + head.size, length, docs
        at += head.size + length


def records(payload: bytes, docs: int, order: str = "little") -> Iterator[tuple]:
    """The records of one chunk's payload."""
    head, at = struct.Struct(ORDERS[order] + "iiiiq"), 0
    for _ in range(docs):
        if at + head.size > len(payload):
            raise FormatError("a record's header runs over its payload")
        *lengths, seconds, millis = head.unpack_from(payload, at)
        if min(lengths) < 0:
            raise FormatError("negative length in a record header")
        at += head.size
        texts = []
        for n in lengths:
            if at + n > len(payload):
                raise FormatError("a record's text runs over its payload")
            try:
                texts.append(payload[at : at + n].decode("utf-8"))
            except UnicodeDecodeError as e:
                raise FormatError("a text is not UTF-8") from e
            at += n
        yield (*texts, seconds, millis)


def write_chunks(file: BinaryIO, chunks: Iterable[list[tuple]], order: str = "little") -> None:
    """Write records (title, body, label, seconds, milliseconds) chunk by chunk."""
    for rows in chunks:
        payload = b""
        for title, body, label, seconds, millis in rows:
            texts = [x.encode() for x in (title, body, label)]
            payload += struct.pack(ORDERS[order] + "iiiiq", *map(len, texts), seconds, millis) + b"".join(texts)
        file.write(struct.pack(ORDERS[order] + "ii", len(rows), len(payload)) + payload)


def _system(path: str):
    """File system and inner path, for any path that pyarrow's file systems know; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def files_of(path: str) -> list[str]:
    """The files that a path means, by name."""
    from pyarrow import fs

    at = min((k for k in (path.find(c) for c in "*?") if k >= 0), default=-1)
    folder, pattern = (path, "*") if at < 0 else (path[: path.rfind("/", 0, at) + 1] or ".", path[path.rfind("/", 0, at) + 1 :])
    system, inner = _system(folder)
    whole = path[: len(path) - len(inner)] if at < 0 and path.endswith(inner) else folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    found = system.get_file_info(inner)
    if found.type is fs.FileType.File:
        return [path]
    names = [x.path for x in system.get_file_info(fs.FileSelector(inner.rstrip("/") or "/", recursive="/" in pattern)) if x.type is fs.FileType.File]
    own = lambda x: x[len(inner.rstrip("/")) + 1 :]
    return sorted(whole + x for x in names if own(x)[:1] not in ("_", ".") and fnmatchcase(own(x), pattern))


class _Chunks(InputPartition):
    def __init__(self, first: int, chunks: list[tuple[str, int, int, int]]):
        self.first, self.chunks = first, chunks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.order = options["path"], options.get("byteorder", "little")
        self.limit = int(options.get("limit", -1))
        self.bytes = int(options.get("partitionbytes", 64 << 20))

    def _walk(self, path: str) -> list[tuple[int, int, int]]:
        with _open(path) as file:
            return list(chunk_headers(file, self.order))

    def partitions(self):
        parts, chunks, first, size, seen = [], [], 0, 0, 0
        paths = files_of(self.path)
        with ThreadPoolExecutor(32) as pool:  # headers are waited for, not worked on
            for path, found in zip(paths, pool.map(self._walk, paths)):
                for at, length, docs in found:
                    if 0 <= self.limit <= seen:
                        break
                    if docs:
                        chunks.append((path, at, length, docs))
                        size, seen = size + length, seen + docs
                    if size >= self.bytes:
                        parts.append(_Chunks(first, chunks))
                        chunks, size, first = [], 0, seen
        return parts + ([_Chunks(first, chunks)] if chunks or not parts else [])

    def read(self, partition):
        import pyarrow as pa

        names = ["doc_id", "title", "body", "random_label", "time_of_day_secs", "timestamp_ms"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        doc_id = partition.first
        for path, at, length, docs in partition.chunks:
            with _open(path) as file:
                file.seek(at)
                rows = list(records(file.read(length), docs, self.order))
            if self.limit >= 0:
                rows = rows[: max(0, self.limit - doc_id)]
            for k in range(0, len(rows), 1024):
                some = rows[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([range(doc_id + k, doc_id + k + len(some)), *zip(*some)], kinds)], names=names)
            doc_id += len(rows)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    """One file for each task, under a name that says its place; files of failed attempts are removed."""

    def __init__(self, options: dict):
        self.path, self.order = options["path"].rstrip("/"), options.get("byteorder", "little")
        self.docs = int(options.get("chunkdocs", 256))

    def write(self, rows):
        from pyspark import TaskContext

        context, chunk = TaskContext.get(), []
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        with system.open_output_stream(f"{inner}/.{name}") as file:
            for row in rows:
                chunk.append(tuple(row[-5:]))
                if len(chunk) == self.docs:
                    write_chunks(file, [chunk], self.order)
                    chunk = []
            if chunk:
                write_chunks(file, [chunk], self.order)
        return _Written(name)

    def commit(self, messages):
        system, inner = _system(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{inner}/.{m.name}", f"{inner}/{m.name}")

    def abort(self, messages):
        system, inner = _system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{inner}/.{m.name}")


class LineDocs(DataSource):
    """spark.read.format("linedocs").load(path); options byteOrder (little, big), limit (first documents), partitionBytes. Writing: option chunkDocs, rows of title, body, random_label, time_of_day_secs and timestamp_ms (a leading doc_id is not kept)."""

    @classmethod
    def name(cls) -> str:
        return "linedocs"

    def schema(self) -> str:
        return "doc_id long, " + LINE_DOCS

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return _Writer({k.lower(): v for k, v in self.options.items()})


def write(docs: DataFrame, path: str, order: str = "little") -> None:
    """Write documents to a folder that all executors see, in the order of doc_id. docs: doc_id, title, body, random_label, time_of_day_secs, timestamp_ms; nulls are empty or 0."""
    docs.sparkSession.dataSource.register(LineDocs)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("title", "body", "random_label")]
    whole = docs.select("doc_id", *texts, F.coalesce(F.col("time_of_day_secs").cast("int"), F.lit(0)).alias("time_of_day_secs"), F.coalesce(F.col("timestamp_ms").cast("long"), F.lit(0).cast("long")).alias("timestamp_ms"))
    whole.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.format("linedocs").option("byteOrder", order).mode("append").save(path)


def read(spark: SparkSession, path: str, limit: int | None = None, order: str = "little") -> DataFrame:
    """doc_id (place in the files, from 0) and the record's columns."""
    spark.dataSource.register(LineDocs)
    reader = spark.read.format("linedocs").option("byteOrder", order)
    return (reader if limit is None else reader.option("limit", limit)).load(path)
