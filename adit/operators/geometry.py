"""Point-cloud slices along X and the geometry risk derived from them.

The cloud is read once for its X range and once to count values per
(slice, axis, coordinate). Scanner coordinates sit on a fixed grid, so that
table is tiny next to the cloud; percentiles, spread, boxes and centroids
all come from it, and no task ever holds a slice's points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.scores import (
    GEOMETRY_WEIGHTS,
    clamp,
    exact_round,
    normalize,
    normalize_inverse,
    risk_level,
    weighted_sum,
)
from adit.operators.quantiles import percentiles
from adit.workspace import materialize, one_row


def x_range(points: DataFrame) -> DataFrame:
    """One written row (lo, hi): the cloud is not read for it again."""
    return materialize(points.agg(F.min("x").alias("lo"), F.max("x").alias("hi")), "x-range")


def slice_values(points: DataFrame, slice_count: int, reach: DataFrame) -> DataFrame:
    """(slice_index, axis, value, weight, sum_x): coordinate counts per slice of the range ``reach``."""
    span = reach.select(F.struct("lo", "hi")).scalar()
    width = (span["hi"] - span["lo"]) / slice_count
    position = F.least(F.lit(slice_count - 1), F.greatest(F.lit(0), ((F.col("x") - span["lo"]) / width).cast("int")))
    index = F.when(width > 0, position).otherwise(F.lit(0))
    axes = F.explode(
        F.array(
            F.struct(F.lit("y").alias("axis"), F.col("y").alias("value")),
            F.struct(F.lit("z").alias("axis"), F.col("z").alias("value")),
        )
    )
    return (
        points.select(index.alias("slice_index"), "x", axes.alias("_a"))
        .groupBy("slice_index", F.col("_a.axis").alias("axis"), F.col("_a.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"), F.sum("x").alias("sum_x"))
    )


def slice_features(points: DataFrame, slice_count: int) -> DataFrame:
    """One row per slice, empty ones with zeros."""
    reach = x_range(points)
    values = materialize(slice_values(points, slice_count, reach), "slice_values")
    cuts = percentiles(values, ["slice_index", "axis"], "value", {"p05": 5, "p75": 75, "p95": 95})
    # Offsets from the p75 keep the sum-of-squares form of the spread accurate.
    top = F.col("value") >= F.col("p75")
    off = F.col("value") - F.col("p75")
    per_axis = (
        values.join(cuts, ["slice_index", "axis"])
        .groupBy("slice_index", "axis")
        .agg(
            F.sum("weight").alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.sum(F.col("value") * F.col("weight")).alias("total"),
            F.sum("sum_x").alias("total_x"),
            F.first("p05").alias("p05"),
            F.first("p95").alias("p95"),
            F.sum(F.when(top, F.col("weight"))).alias("top_n"),
            F.sum(F.when(top, off * F.col("weight"))).alias("top_sum"),
            F.sum(F.when(top, off * off * F.col("weight"))).alias("top_sq"),
        )
    )
    y = {c: F.max(F.when(F.col("axis") == "y", F.col(c))) for c in per_axis.columns[2:]}
    z = {c: F.max(F.when(F.col("axis") == "z", F.col(c))) for c in per_axis.columns[2:]}
    spread = F.sqrt(F.greatest(F.lit(0.0), z["top_sq"] - z["top_sum"] * z["top_sum"] / z["top_n"]) / (z["top_n"] - 1))
    filled = per_axis.groupBy("slice_index").agg(
        z["n"].alias("point_count"),
        (y["hi"] - y["lo"]).alias("bbox_width_y"),
        (z["hi"] - z["lo"]).alias("bbox_height_z"),
        (z["total_x"] / z["n"]).alias("centroid_x"),
        (y["total"] / y["n"]).alias("centroid_y"),
        (z["total"] / z["n"]).alias("centroid_z"),
        (y["p95"] - y["p05"]).alias("width_proxy"),
        (z["p95"] - z["p05"]).alias("height_proxy"),
        z["p95"].alias("ceiling_z_p95"),
        z["p05"].alias("floor_z_p05"),
        F.when(z["top_n"] > 1, spread).otherwise(F.lit(0.0)).alias("ceiling_roughness"),
    )
    span = reach.select(F.struct("lo", "hi")).scalar()
    width = F.coalesce((span["hi"] - span["lo"]) / slice_count, F.lit(0.0))
    slots = points.sparkSession.range(slice_count).select(F.col("id").cast("int").alias("slice_index"))
    measures = filled.columns[2:]
    return slots.join(filled, "slice_index", "left").select(
        "slice_index",
        F.coalesce("point_count", F.lit(0)).cast("bigint").alias("point_count"),
        width.alias("bbox_width_x"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures],
    )


def geometry_risk(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Four scores, their weighted risk and the segment each slice stands for."""
    filled = F.col("point_count") > 0

    def bound(f, column, default):
        return F.coalesce(f(F.when(filled, F.col(column))), F.lit(default))

    span = one_row(
        features,
        *[
            bound(f, c, d).alias(f"{name}_{c}")
            for c in ("width_proxy", "height_proxy", "ceiling_roughness")
            for f, name, d in ((F.min, "lo", 0.0), (F.max, "hi", 1.0))
        ],
    )
    scored = features.withColumn("_span", span)
    lo = {c: F.col(f"_span.lo_{c}") for c in ("width_proxy", "height_proxy", "ceiling_roughness")}
    hi = {c: F.col(f"_span.hi_{c}") for c in lo}
    # One row per slice: the window holds ``slice_count`` rows.
    order = Window.orderBy("slice_index")
    change = sum(
        F.abs(F.col(c) - F.coalesce(F.lag(c).over(order), F.col(c))) for c in ("width_proxy", "height_proxy")
    )
    both = (hi["width_proxy"] - lo["width_proxy"]) + (hi["height_proxy"] - lo["height_proxy"])
    reach = F.when(both == 0, F.lit(1.0)).otherwise(both)
    scored = scored.withColumns(
        {
            "narrowness_score": clamp(
                normalize_inverse(F.col("width_proxy"), lo["width_proxy"], hi["width_proxy"])
            ),
            "low_ceiling_score": clamp(
                normalize_inverse(F.col("height_proxy"), lo["height_proxy"], hi["height_proxy"])
            ),
            "ceiling_roughness_score": normalize(
                F.col("ceiling_roughness"), lo["ceiling_roughness"], hi["ceiling_roughness"]
            ),
            "geometry_change_score": normalize(change, F.lit(0.0), reach),
        }
    ).withColumn("_risk", weighted_sum(GEOMETRY_WEIGHTS))
    count = one_row(segments, F.count(F.lit(1)).alias("n"))["n"]
    owner = segments.select(F.col("seg_no").alias("_owner"), "segment_id")
    return (
        scored.withColumn("_n", count)
        .withColumn("_at", F.when(F.col("_n") > 0, F.col("slice_index") % F.col("_n") + 1))
        .join(owner, F.col("_at") == F.col("_owner"), "left")
        .select(
            F.coalesce("segment_id", F.format_string("SLICE_%03d", "slice_index")).alias("segment_id"),
            *features.columns,
            *[exact_round(F.col(c), 3).alias(c) for c in GEOMETRY_WEIGHTS],
            exact_round(F.col("_risk"), 3).alias("lidar_geometry_risk"),
            risk_level(F.col("_risk")).alias("risk_level"),
        )
    )


def segment_positions(slices: DataFrame) -> DataFrame:
    """Centroid per segment to two decimals; the last slice of a segment wins."""
    axes = F.struct(*[exact_round(F.col(f"centroid_{a}"), 2).alias(a) for a in "xyz"])
    return slices.groupBy("segment_id").agg(F.max_by(axes, "slice_index").alias("p")).select("segment_id", "p.*")


def point_density(slices: DataFrame) -> DataFrame:
    """Points per bounding-box volume of a slice; 0 for a flat or empty box."""
    volume = F.col("bbox_width_x") * F.col("bbox_width_y") * F.col("bbox_height_z")
    return slices.select(
        "slice_index",
        "point_count",
        F.when(volume > 0, F.col("point_count") / volume).otherwise(F.lit(0.0)).alias("point_density"),
    )
