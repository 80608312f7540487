"""Batch jobs around the pipeline: inventory, point samples, publishing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit import schemas
from adit.operators.sampling import point_bounds, window_plan, window_ranges
from adit.plans.pipeline import Pipeline
from adit.sources import files, las, tables


@dataclass(frozen=True)
class Inventory:
    listing: DataFrame
    by_extension: DataFrame
    large_files: DataFrame
    expected: DataFrame
    headers: DataFrame


def inventory(spark: SparkSession, roots: list[str], expected: DataFrame) -> Inventory:
    """What lies below the roots; ``expected`` is (key, label, path)."""
    listing = files.list_files(spark, *roots)
    tracked = listing.where(F.col("extension").isin(*files.TRACKED_EXTENSIONS))
    return Inventory(
        listing=tracked,
        by_extension=files.by_extension(listing),
        large_files=files.large_files(listing),
        expected=files.expected_status(expected, listing),
        headers=las.header_summary(listing, schemas.HEADER),
    )


def sample_summary(points: DataFrame, total: int, target: int) -> DataFrame:
    """Bounds and size of a windowed sample, with the name of the method."""
    per_window, windows = window_plan(total, target)
    # Fixed value: form of the method's name.
    method = f"windowed_distributed_sample_{windows}_windows_{per_window}_records_each"
    count = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    return point_bounds(points).select(
        F.lit(target).alias("target_point_count"),
        count.alias("sampled_point_count"),
        F.lit(method).alias("sampling_method"),
        "*",
    )


def sample_point_file(spark: SparkSession, path: str, target: int, out: str) -> DataFrame:
    """Store a windowed sample of point files; only the windows are read.

    Returns one row on what was stored: source and its size, output and its
    size, method, bounds, and the header of the first source file.
    """
    total = las.point_total(path)
    tables.write_points(las.read_las(spark, path, ranges=window_ranges(spark, total, target)), out)
    sources, stored = files.list_files(spark, path), files.list_files(spark, out)

    def size(listing: DataFrame, extension: str):
        found = listing.where(F.col("extension") == extension).agg(F.sum("size_bytes").alias("b"))
        return files.human_size(F.coalesce(found.scalar(), F.lit(0)))

    headers = las.header_summary(sources, schemas.HEADER).where("header IS NOT NULL")
    header = headers.agg(F.min_by("header", "path").alias("h")).scalar()
    return sample_summary(tables.read_points(spark, out), total, target).select(
        F.lit(path).alias("source"),
        size(sources, ".las").alias("source_size"),
        F.lit(out).alias("output"),
        size(stored, ".parquet").alias("output_size"),
        "*",
        header.alias("header"),
    )


def sample_point_files(spark: SparkSession, targets: list[tuple[str, int, str]]) -> DataFrame:
    """Samples of several sources (path, points wanted, output), one row each."""
    return reduce(DataFrame.unionByName, [sample_point_file(spark, *t) for t in targets])


def publish_all(p: Pipeline, *zones: str) -> None:
    """Write every stage result to each zone; the big timeline by time step."""
    for zone in zones:
        for name in ("segments", "anchors", "sensors", "geometry", "graph", "workers", "gas", "reliability", "event", "scenario"):
            tables.write_json(getattr(p, name), f"{zone}/{name}")
        p.fused.write.mode("overwrite").partitionBy("time_step").parquet(f"{zone}/fused")
