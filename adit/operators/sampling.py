"""Row sampling by position. All of these are filters on an index column."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.functions.scores import exact_round
from adit.workspace import one_row

MAX_WINDOWS = 100


def step_stride(df: DataFrame, steps: int, index: str = "row_idx") -> Column:
    """Rows per step, so that the longest series fills at most ``steps`` steps; one for an empty table."""
    rows = F.coalesce(one_row(df, F.max(index).alias("m"))["m"] + 1, F.lit(1))
    return F.ceil(rows / steps).cast("bigint")


def decimate(df: DataFrame, steps: int, index: str = "row_idx") -> DataFrame:
    """The first row of each step, numbered as ``time_step``.

    The width of a step follows the longest series, so every series is covered
    to its last row, however many rows it has, and no more than ``steps`` rows of
    each are kept. ``step_rows`` is that width.
    """
    return (
        df.withColumn("step_rows", step_stride(df, steps, index))
        .where(F.col(index) % F.col("step_rows") == 0)
        .withColumn("time_step", F.floor(F.col(index) / F.col("step_rows")).cast("int"))
        .drop(index)
    )


def every_nth(points: DataFrame, n: int) -> DataFrame:
    return points.where(F.col("point_idx") % n == 0)


def first_points(points: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` points with coordinates to two decimals."""
    axes = {c: exact_round(F.col(c), 2) for c in ("x", "y", "z")}
    return points.where(F.col("point_idx") < limit).withColumns(axes)


def window_plan(total: int, target: int) -> tuple[int, int]:
    """(records per window, windows) of a windowed sample."""
    wanted = max(0, min(target, total))
    size = math.ceil(wanted / min(MAX_WINDOWS, wanted)) if wanted else 0
    return size, math.ceil(wanted / size) if size else 0


def window_table(spark: SparkSession, total: int, target: int) -> DataFrame:
    """Windows (start, stop, offset) of a windowed sample, at most 100 rows.

    Starts are spread evenly from the first record to the last full window,
    halves going to the even number; the last window takes what is missing.
    ``offset`` is a window's place in the sample.
    """
    size, windows = window_plan(total, target)
    offset = F.col("id") * size
    start = F.bround(F.col("id") * F.lit(float(total - size)) / max(1, windows - 1)).cast("bigint")
    kept = F.least(F.lit(size), F.lit(min(target, total)) - offset)
    return spark.range(windows).select(start.alias("start"), (start + kept).alias("stop"), offset.alias("offset"))


def window_ranges(spark: SparkSession, total: int, target: int) -> list[tuple[int, int]]:
    """The windows as record ranges [start, stop), for sources that can seek."""
    return [(r["start"], r["stop"]) for r in window_table(spark, total, target).orderBy("offset").collect()]


def window_sample(points: DataFrame, total: int, target: int) -> DataFrame:
    """Evenly spread contiguous windows of points; at most 100 windows.

    Overlapping windows repeat their points. The handful of ranges is a
    literal in the plan, so this is one pass with a pushed-down filter and no
    shuffle. ``sample_idx`` is the position in the sample.
    """
    windows = window_table(points.sparkSession, total, target).collect()
    if not windows:
        return points.where(F.lit(False)).withColumn("sample_idx", F.lit(0).cast("bigint"))
    at = F.col("point_idx")
    spans = F.array(*[F.struct(*[F.lit(w[k]).cast("bigint").alias(k) for k in ("start", "stop", "offset")]) for w in windows])
    in_any = reduce(lambda a, b: a | b, ((at >= w["start"]) & (at < w["stop"]) for w in windows))
    hits = F.filter(spans, lambda r: (at >= r["start"]) & (at < r["stop"]))
    return points.where(in_any).withColumn("sample_idx", F.explode(F.transform(hits, lambda r: at - r["start"] + r["offset"])))


def point_bounds(points: DataFrame) -> DataFrame:
    """One row of per-axis minima and maxima; zeros without points."""
    bounds = [F.coalesce(f(c), F.lit(0.0)).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz"]
    return points.agg(*bounds)
