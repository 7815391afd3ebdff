"""Token logs as a streaming source: ``spark.readStream.format("token_log").load(folder)``.

Generators append lines of JSON to files of a folder (answer_id, attempt, seq, piece, is_last, sources, asked, ts; times in
ISO form). Files grow while they are read, which Spark's own file source doesn't allow: here an offset is the number of bytes of each file, up to
the last whole line, so a stream that is restarted goes on where its checkpoint ends, without a gap or a repeat. A batch reads the new bytes of all
files in splits of ``bytesPerSplit``; a line belongs to the split that it begins in.

Edge cases: a last line without its end waits for the next batch; empty lines are passed over; absent fields are null, an absent
attempt is 0; a line that is no object is an error that names its file; a file that has become shorter than its offset is one too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyarrow import json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship
from ..sources.archives import located

SCHEMA = "answer_id string, attempt int, seq int, piece string, is_last boolean, sources string, asked timestamp, ts timestamp"
KINDS = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.timestamp("us", tz="UTC"), pa.timestamp("us", tz="UTC"))
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
BYTES_PER_SPLIT, BATCH = 32 << 20, 4096
BARE_NULL = re.compile(rb"(?:^|\})\s*null", re.MULTILINE)
#: As Arrow reads them at first; times are texts.
RAW = pa.schema([(n, pa.string() if pa.types.is_timestamp(k) else k) for n, k in zip(NAMES, KINDS, strict=True)])


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int
    whole: bool  # whether a line begins at ``start``


def last_line_end(f: pa.NativeFile, least: int, size: int) -> int:
    """The place after the last line feed at or after ``least``, else ``least``."""
    at = size
    while at > least:
        low = max(least, at - (1 << 16))
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return least


def parsed(line: bytes, file: str) -> tuple:
    try:
        r = json.loads(line)
        time = lambda v: None if v is None else t if (t := datetime.fromisoformat(v)).tzinfo else t.replace(tzinfo=UTC)
        return r.get("answer_id"), r.get("attempt") or 0, r.get("seq"), r.get("piece"), bool(r.get("is_last")), r.get("sources"), time(r.get("asked")), time(r.get("ts"))
    except (ValueError, AttributeError, TypeError) as e:
        raise ValueError(f"a line of {file} is no token: {line[:80]!r}") from e


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"]
        self.bytes_per_split = int(options.get("bytesPerSplit", BYTES_PER_SPLIT))
        self.ends: dict[str, tuple[int, int]] = {}  # size and offset as last seen

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        fs, root = located(self.root)
        found = {}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if not info.is_file or info.base_name[:1] in "_.":
                continue
            name = info.path[len(root) :].lstrip("/")
            size, end = self.ends.get(name, (0, 0))
            if info.size > size:
                with fs.open_input_file(info.path) as f:
                    end = last_line_end(f, end, info.size)
                self.ends[name] = (info.size, end)
            if end:
                found[name] = end
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, upto in sorted(end["files"].items()):
            at = start["files"].get(name, 0)
            if at > upto:
                raise ValueError(f"{name} has fewer bytes than were read from it")
            out += [Stretch(name, a, min(a + self.bytes_per_split, upto), a == at) for a in range(at, upto, self.bytes_per_split)]
        return out

    def read(self, split: Stretch) -> Iterator[pa.RecordBatch]:
        fs, root = located(self.root)
        lines = []
        with fs.open_input_file(f"{root.rstrip('/')}/{split.file}") as f:
            for line in _lines(f, split):
                if line.strip():
                    lines.append(line)
                if len(lines) == BATCH:
                    yield tokens_of(lines, split.file)
                    lines = []
        if lines:
            yield tokens_of(lines, split.file)

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint holds the offsets."""


def _lines(f: pa.NativeFile, split: Stretch) -> Iterator[bytes]:
    """Lines that begin in the split; the last may end beyond it."""
    at, rest, size = split.start if split.whole else split.start - 1, b"", f.size()
    skip = not split.whole  # up to the end of the line before
    f.seek(at)
    while True:
        data = f.read(1 << 20)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if not skip:
                yield line
            skip, at = False, at + len(line) + 1
            if at >= split.end:
                return
        if not data or at >= size:
            return


def tokens_of(lines: list[bytes], file: str) -> pa.RecordBatch:
    """Lines read by Arrow; what it doesn't take as it stands is read line by line, which says what is wrong with which."""
    try:
        text = b"\n".join(lines)
        if BARE_NULL.search(text):  # Arrow's reader ends the process at a null that is a row
            raise pa.ArrowInvalid("a null that may be no field")
        t = pajson.read_json(pa.BufferReader(text), pajson.ReadOptions(use_threads=False, block_size=len(text) + 1), pajson.ParseOptions(explicit_schema=RAW, unexpected_field_behavior="ignore"))
        t.validate(full=True)
        if t.num_rows == len(lines):
            t = t.set_column(1, "attempt", pc.fill_null(t["attempt"], 0)).set_column(4, "is_last", pc.fill_null(t["is_last"], False))
            return pa.RecordBatch.from_arrays([t[n].cast(k).combine_chunks() for n, k in zip(NAMES, KINDS, strict=True)], names=NAMES)
    except pa.ArrowException:
        pass
    return _batch([parsed(line, file) for line in lines])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


class TokenLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def token_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The growing logs of a folder as a stream of tokens."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")  # else one batch, without the one that moves the watermark
    spark.dataSource.register(TokenLog)
    return spark.readStream.format("token_log").options(**options).load(path)
