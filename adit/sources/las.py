"""Fixed-length binary point files (LAS) as a Spark data source.

A read is planned from the file headers alone: record ranges become input
partitions, so one large file is spread over the cluster and a sample reads
only the ranges it needs. Records are decoded in NumPy and leave as Arrow
batches. The module depends on nothing else in the package, so it is shipped
to the workers by value.
"""

from __future__ import annotations

import struct
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "las_points"
SCHEMA = "point_idx bigint, x double, y double, z double"

# Header layout (little endian).
MAGIC = b"LASF"
HEADER_BYTES = 375
HEADER_MIN_BYTES = 227
AT_VERSION = 24
AT_HEADER_SIZE = 94
AT_POINT_OFFSET = 96
AT_POINT_FORMAT = 104
AT_RECORD_LENGTH = 105
AT_POINT_COUNT = 107
AT_SCALES = 131
AT_OFFSETS = 155
AT_BOUNDS = 179
AT_LONG_COUNT = 247
POINT_FORMAT_MASK = 0x3F

READ_RECORDS = 250_000
PARTITION_RECORDS = 4_000_000
HEADER_THREADS = 32
# Records of one written file; a task with more starts another.
FILE_RECORDS = 2_000_000
# Records further apart than this are read one by one.
SKIP_BYTES = 1 << 16


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    elif path.startswith("dbfs:"):
        path = "/dbfs/" + path[len("dbfs:") :].lstrip("/")
    elif path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def parse_header(raw: bytes, path: str) -> dict:
    if raw[:4] != MAGIC:
        raise ValueError(f"{path} starts with {raw[:4]!r} instead of {MAGIC!r}")
    if len(raw) < HEADER_MIN_BYTES:
        raise ValueError(f"{path} ends after {len(raw)} of {HEADER_MIN_BYTES} header bytes")

    def at(layout, offset):
        values = struct.unpack_from("<" + layout, raw, offset)
        return values[0] if len(values) == 1 else values

    # Files of version 1.4 may leave the short count empty.
    long_count = at("Q", AT_LONG_COUNT) if len(raw) >= AT_LONG_COUNT + 8 and at("H", AT_HEADER_SIZE) >= AT_LONG_COUNT + 8 else 0
    max_x, min_x, max_y, min_y, max_z, min_z = at("6d", AT_BOUNDS)
    return {
        "signature": MAGIC.decode(),
        "version": f"{raw[AT_VERSION]}.{raw[AT_VERSION + 1]}",
        "header_size": at("H", AT_HEADER_SIZE),
        "offset_to_points": at("I", AT_POINT_OFFSET),
        "point_format": raw[AT_POINT_FORMAT] & POINT_FORMAT_MASK,
        "record_length": at("H", AT_RECORD_LENGTH),
        "point_count": at("I", AT_POINT_COUNT) or long_count,
        "scales": list(at("3d", AT_SCALES)),
        "offsets": list(at("3d", AT_OFFSETS)),
        "mins": [min_x, min_y, min_z],
        "maxs": [max_x, max_y, max_z],
    }


def record_type(length: int) -> np.dtype:
    """A record whose first 12 bytes are the three coordinates."""
    return np.dtype({"names": ["p"], "formats": ["(3,)<i4"], "offsets": [0], "itemsize": length})


def read_header(path: str) -> dict:
    filesystem, inner = open_fs(path)
    with filesystem.open_input_file(inner) as handle:
        return parse_header(handle.read(HEADER_BYTES), path)


def point_files(path: str) -> list[str]:
    """The file itself, or the ``.las`` files of a folder, by name."""
    filesystem, inner = open_fs(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    below = filesystem.get_file_info(fs.FileSelector(inner))
    names = sorted(f.base_name for f in below if f.base_name.lower().endswith(".las"))
    return [f"{path.rstrip('/')}/{name}" for name in names]


@dataclass
class RecordRange(InputPartition):
    path: str
    header: dict
    start: int
    end: int
    first_idx: int


def intersect(start: int, end: int, ranges) -> list[tuple[int, int]]:
    if ranges is None:
        return [(start, end)]
    cut = ((max(start, a), min(end, b)) for a, b in ranges)
    return [(a, b) for a, b in cut if a < b]


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_points = int(options["maxpoints"]) if options.get("maxpoints") else None
        self.chunk = int(options.get("partitionrecords") or PARTITION_RECORDS)
        self.stride = int(options.get("stride") or 1)
        self.ranges = None
        if options.get("ranges"):
            pairs = (r.split("-") for r in options["ranges"].split(","))
            self.ranges = [(int(a), int(b)) for a, b in pairs]

    def partitions(self):
        files = point_files(self.path)
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            headers = list(pool.map(read_header, files))
        parts, offset = [], 0
        for path, header in zip(files, headers):
            count = header["point_count"]
            wanted = count if self.max_points is None else min(count, max(0, self.max_points - offset))
            for a, b in intersect(offset, offset + wanted, self.ranges):
                for start in range(a, b, self.chunk):
                    end = min(b, start + self.chunk)
                    parts.append(RecordRange(path, header, start - offset, end - offset, start))
            offset += count
        # Spark needs a partition even where there is nothing to read.
        return parts or [RecordRange(self.path, {}, 0, 0, 0)]

    def read(self, part: RecordRange):
        if part.start >= part.end:
            return
        header, length = part.header, part.header["record_length"]
        record = record_type(length)
        filesystem, inner = open_fs(part.path)

        def records(handle, start: int, count: int) -> np.ndarray:
            raw = handle.read_at(count * length, header["offset_to_points"] + start * length)
            if len(raw) < count * length:
                raise ValueError(f"{part.path} ends before record {start + len(raw) // length} of {header['point_count']}")
            return np.frombuffer(raw, record, count)["p"]

        # The first record whose number over all files is a multiple of the stride.
        first = part.start + -part.first_idx % self.stride
        step = READ_RECORDS * self.stride if self.stride * length > SKIP_BYTES else max(1, READ_RECORDS // self.stride) * self.stride
        with filesystem.open_input_file(inner) as handle:
            for start in range(first, part.end, step):
                at = np.arange(start, min(part.end, start + step), self.stride)
                if self.stride * length > SKIP_BYTES:
                    grid = np.concatenate([records(handle, int(i), 1) for i in at])
                else:
                    grid = records(handle, start, int(at[-1]) + 1 - start)[:: self.stride]
                idx = at + (part.first_idx - part.start)
                axes = [grid[:, a] * header["scales"][a] + header["offsets"][a] for a in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(idx), *map(pa.array, axes)], ["point_idx", "x", "y", "z"])


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


class LasWriter(DataSourceArrowWriter):
    """Files of bounded size, moved into place when the job commits."""

    SCALE = 0.01
    RECORD_LENGTH = 20

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.scale = float(options.get("scale") or self.SCALE)
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, batches):
        from pyspark import TaskContext

        held, size, names = [], 0, []
        for batch in batches:
            columns = [np.asarray(batch.column(batch.schema.get_field_index(a)), dtype=np.float64) for a in "xyz"]
            # Points are held as they are written, half the size.
            points = np.rint(np.stack(columns, axis=1) / self.scale).astype("<i4")
            while size + len(points) >= FILE_RECORDS:
                cut = FILE_RECORDS - size
                names.append(self._file([*held, points[:cut]], TaskContext.get(), len(names)))
                held, size, points = [], 0, points[cut:]
            if len(points):
                held.append(points)
                size += len(points)
        if size:
            names.append(self._file(held, TaskContext.get(), len(names)))
        return WrittenFiles(names)

    def _file(self, grids: list[np.ndarray], task, number: int) -> str:
        """Write the pieces of one file one after the other."""
        filesystem, staging = open_fs(self.staging)
        grids = [g for g in grids if len(g)]
        most, least = (f([f(g, axis=0) for g in grids], axis=0) * self.scale for f in (np.max, np.min))
        header = bytearray(HEADER_MIN_BYTES)
        header[:4] = MAGIC
        header[AT_VERSION : AT_VERSION + 2] = bytes((1, 2))
        struct.pack_into("<HI", header, AT_HEADER_SIZE, HEADER_MIN_BYTES, HEADER_MIN_BYTES)
        struct.pack_into("<BHI", header, AT_POINT_FORMAT, 0, self.RECORD_LENGTH, sum(map(len, grids)))
        struct.pack_into("<3d", header, AT_SCALES, *[self.scale] * 3)
        struct.pack_into("<6d", header, AT_BOUNDS, *[bound[a] for a in range(3) for bound in (most, least)])
        name = f"part-{task.partitionId():05d}-{number:04d}-{task.taskAttemptId()}.las"
        filesystem.create_dir(staging, recursive=True)
        with filesystem.open_output_stream(f"{staging}/{name}") as out:
            out.write(bytes(header))
            for grid in grids:
                body = np.zeros(len(grid), record_type(self.RECORD_LENGTH))
                body["p"] = grid
                out.write(body.tobytes())
        return name

    def commit(self, messages):
        filesystem, staging = open_fs(self.staging)
        _, target = open_fs(self.path)
        for message in messages:
            for name in message.names if message is not None else ():
                filesystem.move(f"{staging}/{name}", f"{target}/{name}")
        self._drop(filesystem, staging)

    def abort(self, messages):
        self._drop(*open_fs(self.staging))

    @staticmethod
    def _drop(filesystem, staging):
        if filesystem.get_file_info(staging).type == fs.FileType.Directory:
            filesystem.delete_dir(staging)


class LasPoints(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(dict(self.options))

    def writer(self, schema, overwrite):
        return LasWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LasPoints)


def read_las(
    spark: SparkSession,
    path: str,
    max_points: int | None = None,
    stride: int = 1,
    ranges: list[tuple[int, int]] | None = None,
    partition_records: int = PARTITION_RECORDS,
) -> DataFrame:
    """Points of a file or folder; ``point_idx`` counts through the files by name.

    ``ranges`` (global record ranges) and ``stride`` restrict what is read.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path).option("partitionRecords", partition_records)
    if max_points is not None:
        reader = reader.option("maxPoints", max_points)
    if stride > 1:
        reader = reader.option("stride", stride)
    if ranges is not None:
        reader = reader.option("ranges", ",".join(f"{a}-{b}" for a, b in ranges) or "0-0")
    return reader.load()


def write_las(points: DataFrame, path: str, scale: float = LasWriter.SCALE) -> None:
    register(points.sparkSession)
    ordered = points.select("point_idx", "x", "y", "z")
    ordered.write.format(FORMAT).mode("append").option("path", path).option("scale", scale).save()


def point_total(path: str) -> int:
    """Points over all files of a path, from the headers."""
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return sum(h["point_count"] for h in pool.map(read_header, point_files(path)))


def header_rows(batches):
    """Header or error per path; the body of :func:`header_summary`."""
    import pandas as pd

    for batch in batches:
        rows = []
        for path, size in zip(batch["path"], batch["size"]):
            try:
                rows.append((path, size, read_header(path), None))
            except Exception as problem:  # a bad file must not fail the listing
                rows.append((path, size, None, str(problem)))
        yield pd.DataFrame(rows, columns=["path", "size", "header", "error"])


def header_summary(files: DataFrame, header_schema: str) -> DataFrame:
    """One row per ``.las`` file of a listing (path, size, extension)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    paths = files.where("extension = '.las'").select("path", "size").repartition("path")
    header = f"header struct<{struct_fields(header_schema)}>"
    return paths.mapInPandas(header_rows, f"path string, size string, {header}, error string")


def struct_fields(schema: str) -> str:
    """``a int, b array<x>`` to the ``a: int, b: array<x>`` of a struct type."""
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in schema.split(","))
