"""ZIP archives as a data source of Spark, to read and to write: ``spark.read.format("zip_entries").load(folder)``.

A row is an entry: archive, path (in the archive), inner (path below the archive's own first folder), size, content.
Planning reads central directories only and cuts them into splits of about ``bytesPerSplit`` compressed bytes; a
split names a stretch of one directory, so a large archive is read by many tasks and the driver holds no entries. Conditions on path and inner
(equal, one of, begins, ends, not null) are pushed into the source; the options ``prefixes`` (a JSON list, for inner) and ``suffix`` (in either
case) say what no single condition can. Entries that they exclude are neither opened nor planned for. Checksums are verified.

Writing (columns path and content) makes archives of about ``bytesPerArchive``, staged beside their place and moved when
all tasks are done; an aborted job leaves nothing.

Archives live where PyArrow's file systems reach: local and shared folders, HDFS, object stores.

Edge cases: folders, and archives without entries, give no rows; a null path is not written, null content is empty; an encrypted entry or a method other than
stored and deflated is an error that names it, once it is asked for; archives and entries over 4 GB (ZIP64) are read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..session import ship

SCHEMA = "archive string, path string, inner string, size long, content binary"
BYTES_PER_SPLIT, BYTES_PER_ARCHIVE = 64 << 20, 256 << 20
#: Entries of a batch hold at most about so many bytes.
BATCH_BYTES = 16 << 20
END, END64, LOCATOR, RECORD, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes them."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Entry:
    path: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int

    @property
    def inner(self) -> str:
        return self.path.partition("/")[2] if "/" in self.path else self.path


def directory_place(f: pa.NativeFile) -> tuple[int, int, int]:
    """(start, end, bytes before the archive) of the central directory."""
    size = f.size()
    tail = min(size, 65_557)
    f.seek(size - tail)
    data = f.read(tail)
    at = data.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP archive: no end of a central directory")
    n, length, start = struct.unpack_from("<10xHLL", data, at)
    end_at = size - tail + at
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        f.seek(end_at - 20)
        where = f.read(20)
        if where[:4] == LOCATOR:
            end_at = struct.unpack_from("<8xQ", where)[0]
            f.seek(end_at)
            length, start = struct.unpack_from("<40xQQ", f.read(56))
    before = end_at - length - start  # bytes put before the archive
    return start + max(before, 0), start + max(before, 0) + length, max(before, 0)


def records(data: bytes, before: int) -> Iterator[tuple[int, Entry]]:
    """Entries of a stretch of a central directory, each with the place after its record."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != RECORD:
            raise ValueError("broken central directory")
        flags, method, crc, packed, size, names, extra, comment, offset = struct.unpack_from("<4x4xHH4xLLLHHH8xL", data, at)
        name = data[at + 46 : at + 46 + names]
        more, wide = data[at + 46 + names : at + 46 + names + extra], b""
        while len(more) >= 4:
            kind, length = struct.unpack_from("<HH", more)
            if kind == 1:
                wide = more[4 : 4 + length]
            more = more[4 + length :]
        big = []
        for value in (size, packed, offset):
            if value == 0xFFFFFFFF and len(wide) >= 8:
                value, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            big.append(value)
        at += 46 + names + extra + comment
        yield at, Entry(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, crc, big[1], big[0], big[2] + before)


def content(f: pa.NativeFile, e: Entry) -> bytes:
    if e.flags & 1 or e.method not in (0, 8):
        raise ValueError(f"entry {e.path!r} is encrypted or packed by method {e.method}")
    f.seek(e.offset)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"entry {e.path!r} is not where the directory says")
    names, extra = struct.unpack_from("<26xHH", head)
    f.seek(e.offset + 30 + names + extra)
    data = f.read(e.packed)
    data = zlib.decompressobj(-15).decompress(data) if e.method else data
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise ValueError(f"entry {e.path!r} is broken")
    return data


@dataclass
class Split(InputPartition):
    archive: str
    start: int
    end: int
    before: int


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.bytes_per_split = int(options.get("bytesPerSplit", BYTES_PER_SPLIT))
        prefixes = options.get("prefixes")
        self.prefixes = tuple(json.loads(prefixes)) if prefixes else None
        self.suffix = options.get("suffix", "").lower()
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute)
            kind = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", IsNotNull: "any"}.get(type(f))
            if kind is None or column not in ("path", "inner"):
                yield f
            elif kind != "any":
                self.tests.append((column, kind, tuple(f.value) if isinstance(f, In) else (f.value,)))

    def wanted(self, e: Entry) -> bool:
        if e.path.endswith("/") or not e.path.lower().endswith(self.suffix) or (self.prefixes is not None and not e.inner.startswith(self.prefixes)):
            return False
        for column, kind, values in self.tests:
            value = getattr(e, column)
            if not (value in values if kind == "in" else value.startswith(values) if kind == "starts" else value.endswith(values)):
                return False
        return True

    def _archives(self) -> list[str]:
        fs, root = located(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [root]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(root) :].strip("/").split("/"))
        return sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".zip") and not hidden(f.path))

    def _splits(self, archive: str) -> list[Split]:
        fs, _ = located(self.root)
        out: list[Split] = []
        with fs.open_input_file(archive) as f:
            start, end, before = directory_place(f)
            f.seek(start)
            data = f.read(end - start)
        first, last, packed = 0, 0, 0  # of the stretch of directory so far
        for at, e in records(data, before):
            if self.wanted(e):
                first = last if packed == 0 else first
                packed += e.packed + 1
            last = at
            if packed >= self.bytes_per_split:
                out.append(Split(archive, start + first, start + last, before))
                packed = 0
        if packed:
            out.append(Split(archive, start + first, start + last, before))
        return out

    def partitions(self) -> list[Split]:
        with ThreadPoolExecutor(16) as pool:
            return [s for splits in pool.map(self._splits, self._archives()) for s in splits]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.root)
        with fs.open_input_file(split.archive) as f:
            f.seek(split.start)
            rows, held = [], 0
            for _, e in records(f.read(split.end - split.start), split.before):
                if self.wanted(e):
                    rows.append((split.archive, e.path, e.inner, e.size, content(f, e)))
                    held += e.size
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Made(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.bytes_per_archive = int(options.get("bytesPerArchive", BYTES_PER_ARCHIVE))
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("columns path and content are written")
        self.job = uuid.uuid4().hex

    @property
    def stage(self) -> str:
        return f"{located(self.root)[1].rstrip('/')}/_staged-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        fs, _ = located(self.root)
        fs.create_dir(self.stage, recursive=True)
        made: list[str] = []
        out, packed = None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out[0].close()
                out[1].close()
                out = None

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if path is None:
                    continue
                if out is None:
                    made.append(f"{uuid.uuid4().hex}.zip")
                    stream = fs.open_output_stream(f"{self.stage}/{made[-1]}")
                    out, packed = (zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_DEFLATED), stream), 0
                data = data or b""
                out[0].writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)  # without a time, so that equal entries are equal bytes
                packed += len(data)
                if packed >= self.bytes_per_archive:
                    close()
        close()
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        fs, root = located(self.root)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".zip")] if self.overwrite else []
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{self.stage}/{name}", f"{root.rstrip('/')}/{name}")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        fs, _ = located(self.root)
        if fs.get_file_info(self.stage).type != pafs.FileType.NotFound:
            fs.delete_dir(self.stage)


class _Sink:
    """A stream that only goes forward, as the ZIP writer takes it."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


class ZipEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipEntries)


def zip_entries(spark: SparkSession, path: str, prefixes: list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Entries of all archives under ``path``, of some folders and with some ending only, if given."""
    register(spark)
    read = spark.read.format("zip_entries").option("suffix", suffix or "")
    return (read.option("prefixes", json.dumps(prefixes)) if prefixes is not None else read).load(path)


def pack(entries: DataFrame, path: str, mode: str = "append") -> None:
    """``entries`` (path, content) as archives under ``path``."""
    register(entries.sparkSession)
    entries.select("path", "content").write.format("zip_entries").mode(mode).save(path)
