"""Append-only JSONL session logs as a Spark data source, batch and streaming.

Spark's own file stream reads a file once and never looks at what is appended later, so
the tail is a small custom source: a micro-batch is a set of byte ranges, and each range is read by its
own task. Large ranges are cut at `splitBytes`; a task reads the lines that begin inside its range.

The offset of the stream is a version number. The ranges of each version are a file in the folder
`positions`, written before the version is announced; together they say how far each file has been read.
A file is new if no version names it, whatever its modification time. A batch takes at most
`maxFilesPerBatch` files and `maxBytesPerBatch` bytes (one file at least); the rest is for later batches.

Rows: source_file, byte_offset, line. (source_file, byte_offset) identifies a line for
good, so replays produce the same ids.

The stream stops at the last line break that exists when the batch is planned: a
half-written line is read once it is complete, and bytes that arrive meanwhile belong to
the next batch. A batch read returns an unfinished last line as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_file string, byte_offset bigint, line string"
ARROW = pa.schema([("source_file", pa.string()), ("byte_offset", pa.int64()), ("line", pa.string())])
CHUNK = 1 << 20
ROWS_PER_BATCH = 10_000
DEFAULT_SPLIT = 64 << 20
DEFAULT_SETTLE_DAYS = 30
DEFAULT_MAX_FILES = 10_000
DEFAULT_MAX_BYTES = 64 << 30


class ByteRange(InputPartition):
    """Lines of one file that begin in [start, end). `at_line` says that a line begins at
    `start`. No line goes past `stop`."""

    def __init__(self, path: str, start: int, end: int, stop: int, at_line: bool):
        self.path, self.start, self.end, self.stop, self.at_line = path, start, end, stop, at_line


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        # Spark's scheme for the same store; the library takes file URIs with an authority only.
        path = {"s3a": f"s3:{rest}", "s3n": f"s3:{rest}", "file": f"file://{rest if rest.startswith('/') and not rest.startswith('//') else rest.removeprefix('//')}"}.get(scheme, path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_logs(root: str) -> dict[str, tuple[int, float]]:
    """Size and modification time of every .jsonl file below the root."""
    filesystem, base = _filesystem(root)
    found = filesystem.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return {
        f.path: (f.size, f.mtime.timestamp() if f.mtime else 0.0)
        for f in found
        if f.type == pafs.FileType.File and f.path.endswith(".jsonl")
    }


def complete_end(filesystem: pafs.FileSystem, path: str, start: int, size: int) -> int:
    """Position after the last line break in [start, size), or `start` when there is none."""
    with filesystem.open_input_file(path) as f:
        high = size
        while high > start:
            low = max(start, high - CHUNK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def split_range(path: str, start: int, end: int, split_bytes: int) -> list[ByteRange]:
    cuts = list(range(start, end, split_bytes)) + [end]
    return [ByteRange(path, a, b, end, at_line=a == start) for a, b in zip(cuts, cuts[1:])]


def read_lines(part: ByteRange, root: str) -> Iterator[tuple[int, bytes]]:
    """(position, line) for the lines that begin in the range."""
    filesystem, _ = _filesystem(root)
    with filesystem.open_input_file(part.path) as f:
        # One byte earlier shows whether a line begins exactly at the start.
        position = part.start if part.at_line else part.start - 1
        skip = not part.at_line
        f.seek(position)
        rest = b""
        while position < part.end or rest or skip:
            block = f.read(min(CHUNK, part.stop - position - len(rest)))
            if not block:
                break
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                if not skip and position < part.end:
                    yield position, piece
                skip = False
                position += len(piece) + 1
            if position >= part.end:
                return
        if rest and not skip and position < part.end:
            yield position, rest


def read_batches(part: ByteRange, root: str) -> Iterator[pa.RecordBatch]:
    offsets: list[int] = []
    lines: list[str] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())],
            schema=ARROW,
        )
        offsets.clear()
        lines.clear()
        return batch

    for offset, raw in read_lines(part, root):
        offsets.append(offset)
        lines.append(raw.rstrip(b"\r").decode("utf-8", errors="replace"))
        if len(lines) >= ROWS_PER_BATCH:
            yield flush()
    if lines:
        yield flush()


class SessionLogReader(DataSourceReader):
    def __init__(self, root: str, split_bytes: int):
        self.root, self.split_bytes = root, split_bytes

    def partitions(self) -> list[ByteRange]:
        return [
            r
            for path, (size, _) in sorted(list_logs(self.root).items())
            for r in split_range(path, 0, size, self.split_bytes)
            if size
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_batches(partition, self.root)


class Positions:
    """How far each file has been read: the folded ranges of all versions, in one file each."""

    def __init__(self, folder: str):
        self.filesystem, self.folder = _filesystem(folder)
        self.version, self.reached, self.open_line = 0, {}, {}

    def stream_id(self) -> str:
        """A name for the stream that keeps these positions, made once."""
        path = f"{self.folder}/stream_id"
        if self.filesystem.get_file_info(path).type == pafs.FileType.NotFound:
            self.filesystem.create_dir(self.folder, recursive=True)
            with self.filesystem.open_output_stream(path) as f:
                f.write(uuid.uuid4().hex.encode())
        with self.filesystem.open_input_file(path) as f:
            return f.read().decode()

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:010}.json"

    def ranges(self, version: int) -> list[dict]:
        with self.filesystem.open_input_file(self._path(version)) as f:
            return json.loads(f.read())

    def refresh(self) -> None:
        """Take in the versions that others, or an earlier run, have written."""
        found = self.filesystem.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        newest = max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=0)
        while self.version < newest:
            self._take(self.version + 1, self.ranges(self.version + 1))

    def _take(self, version: int, ranges: list[dict]) -> None:
        self.version = version
        for r in ranges:
            self.reached[r["path"]], self.open_line[r["path"]] = r["end"], r["open_line"]

    def add(self, ranges: list[dict]) -> None:
        """Store one more version; under another name first, so that half a file is never read."""
        self.filesystem.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        with self.filesystem.open_output_stream(draft) as f:
            f.write(json.dumps(ranges).encode())
        self.filesystem.move(draft, self._path(self.version + 1))
        self._take(self.version + 1, ranges)


class SessionLogStream(DataSourceStreamReader):
    """The offset is {"version": n}.

    A file that has not changed for `settleDays` before the newest one is read up to its end, with an
    unfinished last line. Should it grow after all, that line is read again, whole. A file that has become
    shorter is another file by the same name and is read from its beginning.

    A version that was stored but not yet logged by Spark when a query died is what the restarted query is
    offered first, so no range is lost or read into two versions.
    """

    def __init__(self, root: str, positions: str, split_bytes: int, settle_days: float, max_files: int, max_bytes: int):
        self.root, self.split_bytes, self.settle_seconds = root, split_bytes, settle_days * 86_400
        self.max_files, self.max_bytes = max_files, max_bytes
        self.positions = Positions(positions)
        self.seen: dict[str, tuple[int, bool]] = {}  # path -> (size, settled) when it was last looked into

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        before = self.positions.version
        self.positions.refresh()
        if self.positions.version > before > 0:
            return {"version": self.positions.version}
        ranges = self._next()
        if ranges:
            self.positions.add(ranges)
        return {"version": self.positions.version}

    def _next(self) -> list[dict]:
        filesystem, _ = _filesystem(self.root)
        logs = list_logs(self.root)
        quiet = max((mtime for _, mtime in logs.values()), default=0.0) - self.settle_seconds
        reached, state = self.positions.reached, {p: (size, mtime <= quiet) for p, (size, mtime) in logs.items()}
        waiting = sorted(p for p, s in state.items() if s[0] != reached.get(p, 0) and self.seen.get(p) != s)
        ranges, total = [], 0
        for at in range(0, len(waiting), 256):
            part = waiting[at : at + 256]
            with ThreadPoolExecutor(16) as pool:
                found = list(pool.map(lambda p: self._range(filesystem, p, *state[p]), part))
            for path, r in zip(part, found):
                size = r["end"] - r["start"] if r else 0
                if r and ranges and (len(ranges) >= self.max_files or total + size > self.max_bytes):
                    return ranges
                self.seen[path] = state[path]
                if r:
                    ranges.append(r)
                    total += size
        return ranges

    def _range(self, filesystem: pafs.FileSystem, path: str, size: int, settled: bool) -> dict | None:
        start = self.positions.reached.get(path, 0)
        if size < start:
            start = 0
        elif start:
            start = self.positions.open_line.get(path, start)
        line_end = complete_end(filesystem, path, start, size)
        end = size if settled else line_end
        return {"path": path, "start": start, "end": end, "open_line": line_end} if end > start else None

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [
            part
            for version in range(start["version"] + 1, end["version"] + 1)
            for r in self.positions.ranges(version)
            for part in split_range(r["path"], r["start"], r["end"], self.split_bytes)
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_batches(partition, self.root)

    def commit(self, end: dict) -> None:
        pass


class SessionLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return int(self.options.get("splitBytes", DEFAULT_SPLIT))

    def reader(self, schema) -> SessionLogReader:
        return SessionLogReader(self.options["path"], self._split())

    def streamReader(self, schema) -> SessionLogStream:
        number = lambda name, default: int(self.options.get(name, default))
        return SessionLogStream(
            self.options["path"],
            self.options["positions"],
            self._split(),
            float(self.options.get("settleDays", DEFAULT_SETTLE_DAYS)),
            number("maxFilesPerBatch", DEFAULT_MAX_FILES),
            number("maxBytesPerBatch", DEFAULT_MAX_BYTES),
        )
