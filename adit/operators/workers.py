"""Worker tracks: sampled timeline, segment mapping and motion state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.scores import distance, exact_round, magnitude
from adit.functions.text import canonical_record, canonical_segment_id, to_float
from adit.operators.sampling import decimate
from adit.workspace import one_row

# Motion thresholds and position reliabilities.
FALL_ACCELERATION = 18.0
STILL_DISTANCE = 0.01
FAST_DISTANCE = 1.5
FAST_RELIABILITY = 0.78
STATIONARY_RELIABILITY = 0.92
OTHER_RELIABILITY = 0.86
# Fixed value: segment of a pose that maps to none.
FIRST_SEGMENT = "SEG_001"


def motion_status(acceleration: Column, previous: Column, pose: Column) -> Column:
    moved = distance(previous, pose)
    return (
        F.when(previous.isNull(), F.lit("moving"))
        .when(acceleration > FALL_ACCELERATION, F.lit("possible_fall"))
        .when(moved < STILL_DISTANCE, F.lit("still"))
        .when(moved > FAST_DISTANCE, F.lit("fast_motion"))
        .otherwise(F.lit("moving"))
    )


def worker_timeline(tracks: DataFrame, segments: DataFrame, steps: int) -> DataFrame:
    """Tracks (worker_id, row_idx, pose_*, acc_*) to one row per worker and step.

    Progress along X over all sampled rows picks the segment by its number.
    """
    cells = {c: to_float(F.col(c)) for c in ("pose_x", "pose_y", "pose_z", "acc_x", "acc_y", "acc_z")}
    sampled = decimate(tracks, steps).withColumns(cells)
    span = one_row(sampled, F.min("pose_x").alias("lo"), F.max("pose_x").alias("hi"))
    count = one_row(segments, F.count(F.lit(1)).alias("n"))["n"]
    progress = (F.col("pose_x") - span["lo"]) / F.greatest(span["hi"] - span["lo"], F.lit(1e-9))
    number = F.least(count - 1, F.greatest(F.lit(0), (progress * count).cast("bigint"))) + 1
    # At most ``steps`` rows per worker are left after sampling.
    history = Window.partitionBy("worker_id").orderBy("time_step")
    pose = F.struct(F.col("pose_x").alias("x"), F.col("pose_y").alias("y"), F.col("pose_z").alias("z"))
    moved = (
        sampled.withColumn("uwb_pose", pose)
        .withColumn("_acc", magnitude(F.col("acc_x"), F.col("acc_y"), F.col("acc_z")))
        .withColumn("_number", number)
        .withColumn("_previous", F.lag("uwb_pose").over(history))
        .withColumn("motion_status", motion_status(F.col("_acc"), F.col("_previous"), F.col("uwb_pose")))
    )
    places = segments.select(F.col("seg_no").alias("_number"), F.col("segment_id").alias("mapped_segment_id"))
    return moved.join(places, "_number", "left").select(
        "time_step",
        "worker_id",
        "uwb_pose",
        F.coalesce("mapped_segment_id", F.lit(FIRST_SEGMENT)).alias("mapped_segment_id"),
        exact_round(F.col("_acc"), 4).alias("acc_magnitude"),
        "motion_status",
        F.format_string("first_of_every_%d_rows", "step_rows").alias("source_row_policy"),
    )


def position_reliability(motion: Column) -> Column:
    return (
        F.when(motion == "fast_motion", F.lit(FAST_RELIABILITY))
        .when(motion == "stationary", F.lit(STATIONARY_RELIABILITY))
        .otherwise(F.lit(OTHER_RELIABILITY))
    )


def worker_view(workers: DataFrame) -> DataFrame:
    """Worker rows as the service shows them (already filtered by step)."""
    view = canonical_record(workers)
    mapped = F.col("mapped_segment_id") if "mapped_segment_id" in view.columns else F.lit(None).cast("string")
    view = view.withColumn("current_segment", canonical_segment_id(mapped))
    if "uwb_pose" in view.columns:
        view = view.withColumn("position", F.col("uwb_pose"))
    motion = F.col("motion_status") if "motion_status" in view.columns else F.lit(None).cast("string")
    defaults = {"position_reliability": position_reliability(motion), "status": F.lit("safe")}
    return view.withColumns({c: v for c, v in defaults.items() if c not in view.columns})
