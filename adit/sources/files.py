"""File listing, expected-source status and point-file header summary."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.functions.text import human_size
from adit.sources.las import open_fs
from adit.workspace import materialize_counted

# File kinds that are counted, folders that are skipped, size of a large file.
TRACKED_EXTENSIONS = (
    ".las", ".laz", ".csv", ".dat", ".json", ".npz", ".png", ".jpg", ".jpeg", ".html", ".bag",
)
SKIPPED_FOLDERS = (".git", "__pycache__", ".venv")
LARGE_FILE_BYTES = 100 * 1024 * 1024


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of folders (path, inside); a file gives itself, what is missing nothing."""
    for batch in batches:
        paths, lengths, folders = [], [], []
        for path in batch.column(0).to_pylist():
            filesystem, inner = open_fs(path)
            info = filesystem.get_file_info(inner)
            if info.type == fs.FileType.File:
                paths.append(path)
                lengths.append(info.size)
                folders.append(False)
            elif info.type == fs.FileType.Directory:
                for entry in filesystem.get_file_info(fs.FileSelector(inner)):
                    paths.append(f"{path.rstrip('/')}/{entry.base_name}")
                    lengths.append(entry.size or 0)
                    folders.append(entry.type == fs.FileType.Directory)
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(folders, pa.bool_())], ["path", "length", "folder"])


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, size_bytes, size, extension) of all files below the roots.

    Folders are listed in tasks, one level after the other, without reading
    content. Roots that do not exist are left out. Folders that are never
    wanted are skipped below the roots only; hidden names are listed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[open_fs.__module__])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    schema = "path string, length bigint, folder boolean"
    folders, levels = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string"), []
    name = F.substring_index("path", "/", -1)
    n = len(roots)
    while n:
        found = folders.repartition("path").mapInArrow(_children, schema).where(~(F.col("folder") & name.isin(*SKIPPED_FOLDERS)))
        found, n = materialize_counted(found, "listing", F.col("folder"))
        levels.append(found.where(~F.col("folder")).select("path", "length"))
        folders = found.where("folder").select("path")
    listed = reduce(DataFrame.union, levels) if levels else spark.createDataFrame([], "path string, length bigint")
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return listed.distinct().select(
        "path",
        F.col("length").alias("size_bytes"),
        human_size(F.col("length")).alias("size"),
        F.lower(suffix).alias("extension"),
    )


def by_extension(files: DataFrame, tracked=TRACKED_EXTENSIONS) -> DataFrame:
    return (
        files.where(F.col("extension").isin(*tracked))
        .groupBy("extension")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    )


def large_files(files: DataFrame, k: int = 20, at_least: int = LARGE_FILE_BYTES) -> DataFrame:
    return files.where(F.col("size_bytes") >= at_least).orderBy(F.desc("size_bytes"), "path").limit(k)


def expected_status(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``expected`` (key, label, path) with whether the file or folder was found."""
    exact = files.select(F.col("path").alias("_p"), F.col("size").alias("_size"))
    # A folder counts as found when a listed file lies directly or deeper below it.
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    folders = files.select(F.explode(above).alias("_d")).distinct()
    return (
        expected.join(exact, F.col("path") == F.col("_p"), "left")
        .join(folders, F.col("path") == F.col("_d"), "left")
        .select(
            "key",
            "label",
            "path",
            (F.col("_p").isNotNull() | F.col("_d").isNotNull()).alias("exists"),
            F.col("_size").alias("size"),
        )
    )
