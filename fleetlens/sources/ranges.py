"""Files of a folder tree read in byte ranges, with true offsets.

A Spark data source that plans ranges of each file and packs them into tasks of about equal size.  A range of a text file gives
the lines that begin in it, each with the byte it begins at, so no order of rows has to be kept to know a line's place.  A range
of a record file starts at a whole record.  Compressed files are one range and are unpacked as a stream.  Unlike Spark's own
file sources it also reads names that begin with a dot, as shell histories do.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetlens.sources.lines import glob_regex

SPLIT_BYTES = 64 << 20
#: Bytes read from a file, and handed on, at once.
PIECE = 4 << 20
#: Bytes read at once behind a range, for the end of its last line.
TAIL = 1 << 14
#: Ranges shorter than a task are packed into so many tasks per core, of at least so many bytes.
TASKS_PER_CORE = 4
TASK_BYTES = 1 << 20
UNPACKED = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
MANY = re.compile(r"[*?\[{]")

LINE_SCHEMA = "file string, mtime double, split_start bigint, line_in_split bigint, byte_offset bigint, raw binary"
COUNT_SCHEMA = "file string, split_start bigint, split_lines bigint"
RECORD_SCHEMA = "file string, mtime double, size bigint, record_index bigint, record binary"


@dataclass(frozen=True)
class FileFacts:
    uri: str
    size: int
    mtime: float

    @property
    def unpack(self):
        return next((fn for suffix, fn in UNPACKED.items() if self.uri.endswith(suffix)), None)


@dataclass
class Ranges(InputPartition):
    """(file, first byte, last byte + 1) of one task."""

    parts: list[tuple[FileFacts, int, int]]


def file_system(uri: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    scheme = urlsplit(uri).scheme
    if len(scheme) < 2:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    system, _ = fs.FileSystem.from_uri(quote(uri, safe=":/@%"))
    return system, unquote(uri.split("://", 1)[1])


def _alternatives(pattern: str) -> list[str]:
    """The patterns that braces stand for."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    return [x for one in found[1].split(",") for x in _alternatives(pattern[: found.start()] + one + pattern[found.end():])]


def _part_regex(part: str) -> str:
    """One level of a path: * and ? do not match /."""
    return glob_regex(part).replace("(?s)^", "").replace(".*", "[^/]*").removesuffix("$")


def list_files(paths: Sequence[str]) -> list[FileFacts]:
    """The files that paths name: a file, a folder (all files below it), or a pattern of either."""
    from pyarrow import fs

    found: dict[str, FileFacts] = {}
    for pattern in (x for p in paths for x in _alternatives(p)):
        system, path = file_system(pattern)
        prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
        parts = path.split("/")
        fixed = next((k for k, part in enumerate(parts) if MANY.search(part)), None)
        base = path if fixed is None else "/".join(parts[:fixed]) or "/"
        info = system.get_file_info(base)
        below = [info] if info.type == fs.FileType.File else system.get_file_info(
            fs.FileSelector(base, recursive=True, allow_not_found=True))
        wanted = None if fixed is None else re.compile(
            re.escape("/".join(parts[:fixed])) + "".join("/" + _part_regex(x) for x in parts[fixed:]) + r"(?:/.*)?\Z", re.S)
        for x in below:
            if x.type == fs.FileType.File and (wanted is None or wanted.match(x.path if x.path.startswith("/") or not path.startswith("/") else "/" + x.path)):
                uri = prefix + x.path
                found[uri] = FileFacts(uri, x.size, x.mtime.timestamp() if x.mtime else 0.0)
    return [found[u] for u in sorted(found)]


def plan_ranges(files: Sequence[FileFacts], split: int, width: int = 1, cores: int | None = None) -> list[Ranges]:
    """Ranges of at most ``split`` bytes, whole records of ``width``, packed into tasks of about as much.

    With ``cores``, short ranges are packed into tasks of up to 64 MB, as long as each core has a few, so that the number of
    tasks does not grow with every range.
    """
    step = max(width, split // width * width)
    if cores:
        share = (sum(f.size for f in files) + (len(files) << 16)) // (cores * TASKS_PER_CORE)
        split = max(split, min(SPLIT_BYTES, max(share, TASK_BYTES)))
    tasks: list[Ranges] = []
    waiting: list[tuple[FileFacts, int, int]] = []
    load = 0
    for file in files:
        cuts = [0] if file.unpack or not file.size else range(0, file.size, step)
        for start in cuts:
            end = file.size if file.unpack else min(start + step, file.size)
            if waiting and load + end - start > split:
                tasks.append(Ranges(waiting))
                waiting, load = [], 0
            # Neighbouring ranges of one task are read through one open file; a file costs some time to open, however short.
            load += end - start + (0 if waiting and waiting[-1][0] is file else 1 << 16)
            waiting.append((file, start, end))
    if waiting:
        tasks.append(Ranges(waiting))
    return tasks


def open_at(file: FileFacts, start: int) -> io.BufferedIOBase:
    system, path = file_system(file.uri)
    raw = system.open_input_file(path)
    if file.unpack:
        return file.unpack(raw)
    raw.seek(start)
    return raw


def lines_between(stream, start: int, end: int | None, first: bool) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(offset, bytes, ends of lines) of consecutive pieces of whole lines that begin in [start, end).

    ``stream`` stands at ``start``, or one byte before it unless ``first``: a line begins here only if that byte ends one.
    """
    at, rest, skip = start - (not first), b"", not first
    read = at
    while True:
        # No more than the range, and then only as far as its last line goes.
        want = PIECE if end is None else min(PIECE, end - read) if read < end else min(PIECE, max(TAIL, len(rest)))
        data = stream.read(want)
        read += len(data)
        if not data:
            if rest and not skip and (end is None or at < end):
                yield at, rest, np.array([len(rest)])
            return
        data = rest + data
        if skip:
            cut = data.find(b"\n") + 1
            if not cut:
                at, rest = at + len(data), b""
                if end is not None and at >= end:
                    return
                continue
            data, at, skip = data[cut:], at + cut, False
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if end is not None:
            begins = at + np.concatenate([[0], ends])
            ends = ends[: int(np.searchsorted(begins, end))]
        whole = int(ends[-1]) if len(ends) else 0
        if whole:
            yield at, data[:whole], ends
        at, rest = at + whole, data[whole:]
        if end is not None and at >= end:
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.cores = int(options.get("cores", 0)) or None

    width = 1

    def files(self) -> list[FileFacts]:
        return list_files(self.paths)

    def partitions(self) -> Sequence[InputPartition]:
        return plan_ranges(self.files(), self.split, self.width, self.cores) or [Ranges([])]

    def pieces(self, partition: Ranges) -> Iterator[tuple[FileFacts, int, Iterator[tuple[int, bytes, np.ndarray]]]]:
        """(file, first byte, pieces of lines) of a task's ranges, one after the other."""
        for file, parts in groupby(partition.parts, key=lambda part: part[0]):
            with open_at(file, 0) as stream:
                for _, start, end in parts:
                    first = start == 0
                    if not file.unpack:
                        stream.seek(start - (not first))
                    yield file, start, lines_between(stream, start, None if file.unpack else end, first)


class LineReader(_Reader):
    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for file, start, pieces in self.pieces(partition):
            number = 0
            for at, data, ends in pieces:
                n = len(ends)
                begins = np.concatenate([[0], ends[:-1]])
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
                yield pa.record_batch([
                    pa.array([file.uri] * n, pa.string()), pa.array(np.full(n, file.mtime)), pa.array(np.full(n, start, np.int64)),
                    pa.array(np.arange(number + 1, number + n + 1)), pa.array(at + begins), raw],
                    ["file", "mtime", "split_start", "line_in_split", "byte_offset", "raw"])
                number += n


class CountReader(_Reader):
    """Lines per range of the files that have more than one."""

    def files(self) -> list[FileFacts]:
        return [f for f in super().files() if not f.unpack and f.size > self.split]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for file, start, pieces in self.pieces(partition):
            yield file.uri, start, sum(len(ends) for _, _, ends in pieces)


class RecordReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.width = int(options["width"])

    def joined(self, partition: Ranges) -> Iterator[tuple[FileFacts, int, int]]:
        """A task's ranges of each file as one, for they follow each other; a record's number comes from its place."""
        for file, parts in groupby(partition.parts, key=lambda part: part[0]):
            spans = list(parts)
            yield file, spans[0][1], spans[-1][2]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for file, start, end in self.joined(partition):
            with open_at(file, start) as stream:
                at = start
                while True:
                    want = max(self.width, PIECE // self.width * self.width)
                    data = stream.read(want if file.unpack else min(want, end - at))
                    while file.unpack and data and len(data) % self.width:
                        more = stream.read(self.width - len(data) % self.width)
                        if not more:
                            break
                        data += more
                    n = len(data) // self.width
                    if n:
                        records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.width), n, [None, pa.py_buffer(data[: n * self.width])])
                        yield pa.record_batch([
                            pa.array([file.uri] * n, pa.string()), pa.array(np.full(n, file.mtime)), pa.array(np.full(n, file.size, np.int64)),
                            pa.array(at // self.width + np.arange(n)), records.cast(pa.binary())],
                            ["file", "mtime", "size", "record_index", "record"])
                    at += len(data)
                    if not data or len(data) % self.width or (not file.unpack and at >= end):
                        break


class LineRanges(DataSource):
    """Lines with their offsets; options ``paths`` (one a line) and ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "fleet_lines"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineCounts(DataSource):
    """Lines per range of files with several ranges, planned as by ``fleet_lines``."""

    @classmethod
    def name(cls) -> str:
        return "fleet_line_counts"

    def schema(self) -> str:
        return COUNT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CountReader(self.options)


class RecordRanges(DataSource):
    """Records of ``width`` bytes with their number; a shorter rest at the end of a file is left out."""

    @classmethod
    def name(cls) -> str:
        return "fleet_records"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


def scan(spark, kind: type[DataSource], paths: str | Sequence[str], split_bytes: int, **options):
    spark.dataSource.register(kind)
    text = "\n".join([paths] if isinstance(paths, str) else paths)
    return spark.read.format(kind.name()).options(
        paths=text, split_bytes=str(split_bytes), cores=str(spark.sparkContext.defaultParallelism), **options).load()
