"""Numbered lines of text files as a Spark data source.

File order matters in this domain, so rows need numbers that depend on nothing
but the files. The byte ranges to read are planned once, by the driver: files
by name, each from the end of its header line in steps of a fixed size. A range
owns the lines that begin in it. One pass counts the lines of every range; the
sums go into the plan and the second pass numbers its lines while it reads.
Both passes use the same plan, whatever the cluster looks like meanwhile, and
nothing is sorted, shuffled or copied.

Lines are cut in NumPy and leave as Arrow batches. The module is shipped to
the workers by value.
"""

from __future__ import annotations

import base64
import csv
import json
import sys
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from adit.sources import las

FORMAT = "numbered_lines"
LINES, COUNTS = "row_idx bigint, file_no int, offset bigint, line string", "number int, n bigint"
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
THREADS = 32
MARK = b"\xef\xbb\xbf"
#: Stores that are opened here; paths of others, and patterns, are left to Spark's own reader.
STORES = {"", "file", "dbfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss"}
#: Compressed files can't be entered in the middle, so they are one range.
PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class TextFile:
    path: str
    size: int
    start: int
    header: str


@dataclass
class Plan:
    """Files in order, the size of their ranges and, after the counting pass, the number of each range's first line."""

    files: list[TextFile]
    range_bytes: int
    firsts: list[int] | None = None
    total: int | None = None

    def ranges(self) -> list[LineRange]:
        found = []
        for no, file in enumerate(self.files):
            packed = file.path.endswith(PACKED) and file.size > 0
            for start in [file.start] if packed else range(file.start, file.size, self.range_bytes):
                found.append(LineRange(len(found), no, file.path, file.start, start, min(file.size, start + self.range_bytes), 0))
        for part, first in zip(found, self.firsts or ()):
            part.first = first
        return found

    def pack(self) -> str:
        return base64.b64encode(zlib.compress(json.dumps(asdict(self)).encode())).decode()

    @staticmethod
    def unpack(text: str) -> Plan:
        raw = json.loads(zlib.decompress(base64.b64decode(text)))
        return Plan([TextFile(**f) for f in raw.pop("files")], **raw)


@dataclass
class LineRange(InputPartition):
    number: int
    file_no: int
    path: str
    data_start: int
    start: int
    end: int
    first: int


def opens(path: str) -> bool:
    """Whether the files of a path can be listed and read here."""
    scheme = path.split(":", 1)[0] if "://" in path or path.startswith(("file:", "dbfs:")) else ""
    return scheme in STORES and not any(c in path for c in "*?[{")


def text_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file itself or of a folder's files by name, without hidden ones."""
    filesystem, inner = las.open_fs(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    below = [f for f in filesystem.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    shown = sorted((f.base_name, f.size) for f in below if not f.base_name.startswith(("_", ".")))
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in shown]


def _open(path: str, at: int):
    filesystem, inner = las.open_fs(path)
    if path.endswith(PACKED):
        return filesystem.open_input_stream(inner)
    handle = filesystem.open_input_file(inner)
    handle.seek(at)
    return handle


def head(path: str, size: int, header: bool) -> TextFile:
    """A file with its header, the first line that is not blank, and where its data begin."""
    with _open(path, 0) as handle:
        raw, at = handle.read(1 << 16), 0
        mark = len(MARK) if raw.startswith(MARK) else 0
        at = mark
        while header:
            end = raw.find(b"\n", at)
            if end < 0:
                more = handle.read(1 << 16)
                if more:
                    raw += more
                    continue
                end = len(raw)
            line = raw[at:end]
            at = min(end + 1, len(raw))
            if line.strip() or end >= len(raw):
                return TextFile(path, size, at, line.decode("utf-8", "replace").rstrip("\r"))
    return TextFile(path, size, mark, "")


def plan_lines(path: str, header: bool = True, range_bytes: int = RANGE_BYTES) -> Plan:
    with ThreadPoolExecutor(THREADS) as pool:
        files = list(pool.map(lambda f: head(*f, header), text_files(path)))
    return Plan(files, range_bytes)


def cut_lines(part: LineRange) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Blocks of a range as (bytes, line starts, line ends, offset of the block), blank lines left out."""
    packed = part.path.endswith(PACKED)
    at = part.data_start if packed else max(part.data_start, part.start - 1)
    # A line begins after a line end, so the byte before the range decides about its first one.
    skip = part.start > part.data_start
    limit = None if packed else part.end
    with _open(part.path, at) as handle:
        if packed:
            handle.read(at)
        held = b""
        while True:
            block = handle.read(max(READ_BYTES, len(held)))
            raw = np.frombuffer(held + block, np.uint8)
            ends = np.flatnonzero(raw == 10)
            if not block and len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
                ends = np.append(ends, len(raw))
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            done = int(ends[-1]) + 1 if len(ends) else 0
            if skip and len(ends):
                starts, ends, skip = starts[1:], ends[1:], False
            if limit is not None:
                inside = starts + at < limit
                starts, ends, over = starts[inside], ends[inside], not inside.all()
            else:
                over = False
            if len(ends):
                ink = np.concatenate([[0], np.cumsum(raw > 32)])
                inked = ink[ends] > ink[starts]
                starts, ends = starts[inked], ends[inked]
                ends = ends - (raw[ends - 1] == 13) if len(ends) else ends
                yield raw, starts, ends, at
            if not block or over or (limit is not None and not skip and at + done >= limit):
                return
            held = raw[done:].tobytes()
            at += done


def as_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lines as an Arrow array; bytes that are no UTF-8 are replaced."""
    turns = np.zeros(len(raw) + 1, np.int8)
    turns[starts] = 1
    turns[ends] = -1
    kept = raw[np.cumsum(turns[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    lines = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        lines = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends)], pa.string())
    return lines


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan = Plan.unpack(options["plan"])
        self.counting = self.plan.firsts is None
        self.most = int(options["maxrows"]) if options.get("maxrows") else None

    def partitions(self):
        ranges = [r for r in self.plan.ranges() if self.most is None or r.first < self.most]
        # Spark needs a partition even where there is nothing to read.
        return ranges or [LineRange(-1, 0, "", 0, 0, 0, 0)]

    def read(self, part: LineRange):
        if part.number < 0:
            return
        if self.counting:
            n = sum(len(starts) for _, starts, _, _ in cut_lines(part))
            yield pa.record_batch([pa.array([part.number], pa.int32()), pa.array([n], pa.int64())], ["number", "n"])
            return
        row = part.first
        for raw, starts, ends, at in cut_lines(part):
            if self.most is not None:
                starts, ends = starts[: max(0, self.most - row)], ends[: max(0, self.most - row)]
            if not len(starts):
                continue
            n = len(starts)
            columns = [np.arange(row, row + n), np.full(n, part.file_no, np.int32), starts.astype(np.int64) + at]
            yield pa.record_batch([*map(pa.array, columns), as_strings(raw, starts, ends)], ["row_idx", "file_no", "offset", "line"])
            row += n


class NumberedLines(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return COUNTS if Plan.unpack(self.options["plan"]).firsts is None else LINES

    def reader(self, schema):
        return LineReader(dict(self.options))


def load(spark: SparkSession, plan: Plan, max_rows: int | None = None) -> DataFrame:
    for module in (las, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(NumberedLines)
    reader = spark.read.format(FORMAT).option("plan", plan.pack())
    return (reader if max_rows is None else reader.option("maxRows", max_rows)).load()


def count_lines(spark: SparkSession, plan: Plan) -> Plan:
    """The plan with the number of the first line of every range; one number per range comes back."""
    if not plan.ranges():
        return Plan(plan.files, plan.range_bytes, [], 0)
    counts = [r["n"] for r in sorted(load(spark, plan).collect(), key=lambda r: r["number"])]
    *firsts, total = accumulate(counts, initial=0)
    return Plan(plan.files, plan.range_bytes, firsts, total)


def read_numbered_lines(spark: SparkSession, path: str, header: bool = True, range_bytes: int = RANGE_BYTES, max_rows: int | None = None) -> DataFrame:
    """(row_idx, file_no, offset, line) of a file or folder, numbered from 0 through the files by name.

    Blank lines and, with ``header``, the first line of each file have no
    number. ``offset`` is the byte in the file, unpacked, where a line begins.
    Ranges beyond ``max_rows`` are not read again.
    """
    return load(spark, count_lines(spark, plan_lines(path, header, range_bytes)), max_rows)


def header_names(plan: Plan) -> list[str]:
    """Column names of the first file that has any."""
    lines = [f.header for f in plan.files if f.header.strip()]
    return next(csv.reader(lines[:1]), []) if lines else []
