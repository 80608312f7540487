"""Fused risk per segment and time step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.scores import FUSION_WEIGHTS, confidence_factor, exact_round, risk_level, weighted_sum
from adit.functions.text import active_reasons, as_map, canonical_record, reasons
from adit.operators.steps import max_time_step, over_steps


def occupied_cells(workers: DataFrame, gas: DataFrame, reliability: DataFrame) -> DataFrame:
    """What is known per (time_step, segment_id): gas readings and workers.

    Both sides are stacked and grouped once, so the dense grid needs a
    single join.
    """
    by_sensor = reliability.groupBy("sensor_id").agg(F.min("sensor_reliability_score").alias("_reliability"))
    readings = gas.join(by_sensor, "sensor_id", "left").select(
        "time_step",
        "segment_id",
        F.col("methane_risk_score").alias("_methane"),
        F.coalesce("_reliability", F.lit(100.0)).alias("_reliability"),
        "sensor_id",
        F.lit(None).cast("string").alias("worker_id"),
    )
    people = workers.select(
        "time_step",
        F.col("mapped_segment_id").alias("segment_id"),
        F.lit(None).cast("double").alias("_methane"),
        F.lit(None).cast("double").alias("_reliability"),
        F.lit(None).cast("string").alias("sensor_id"),
        F.col("worker_id").cast("string").alias("worker_id"),
    )
    return (
        readings.unionByName(people)
        .groupBy("time_step", "segment_id")
        .agg(
            F.max("_methane").alias("_methane"),
            F.min("_reliability").alias("_reliability"),
            F.sort_array(F.collect_list("sensor_id")).alias("_sensors"),
            F.sort_array(F.collect_set("worker_id")).alias("_workers"),
        )
    )


def cell_scores(methane: Column, reliability: Column, workers: Column) -> dict[str, Column]:
    """What follows from the readings and workers of a (time_step, segment_id) alone."""
    adjusted = methane * confidence_factor(reliability)
    exposure = F.when(F.size(workers) > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    texts = reasons(F.lit(0.0), F.lit(0.0), methane, adjusted, exposure)
    return {
        "adjusted_methane": adjusted,
        "worker_exposure_score": exposure,
        "methane_risk_score": exact_round(adjusted, 3),
        "raw_methane_risk_score": exact_round(methane, 3),
        "sensor_reliability_score": exact_round(reliability, 3),
        "_gas": texts["gas"],
        "_worker": texts["worker"],
    }


def fuse(
    segments: DataFrame,
    geometry: DataFrame,
    graph: DataFrame,
    workers: DataFrame,
    gas: DataFrame,
    reliability: DataFrame,
    weights: dict[str, float] = FUSION_WEIGHTS,
) -> DataFrame:
    """Dense (time_step x segment) risk timeline.

    Everything that depends on the segment alone is worked out before the steps
    are generated, and what depends on readings and workers per occupied cell;
    cells without any share one set of constants.
    """
    shape = geometry.groupBy("segment_id").agg(
        F.greatest(F.lit(0.0), F.max("lidar_geometry_risk")).alias("lidar_geometry_risk")
    )
    zero, empty = F.lit(0.0), F.array().cast("array<string>")
    lidar, blocking = F.coalesce("lidar_geometry_risk", zero), F.coalesce("graph_risk_score", zero)
    shown = reasons(lidar, blocking, zero, zero, zero)
    by_segment = (
        segments.select("seg_no", "segment_id")
        .join(shape, "segment_id", "left")
        .join(graph.select("segment_id", "graph_risk_score"), "segment_id", "left")
        .select(
            "seg_no",
            "segment_id",
            lidar.alias("lidar_geometry_risk"),
            blocking.alias("graph_risk_score"),
            exact_round(lidar, 3).alias("_lidar"),
            exact_round(blocking, 3).alias("_graph"),
            shown["lidar"].alias("_lidar_reason"),
            shown["graph"].alias("_graph_reason"),
        )
    )
    grid = over_steps(by_segment, max_time_step(workers, gas), "segment_id")
    vacant = cell_scores(zero, F.lit(100.0), empty)
    known = cell_scores(F.col("_methane"), F.col("_reliability"), F.col("_workers"))
    cells = (
        occupied_cells(workers, gas, reliability)
        .withColumns({"_methane": F.coalesce("_methane", zero), "_reliability": F.coalesce("_reliability", F.lit(100.0))})
        .select("time_step", "segment_id", "_workers", "_sensors", *[c.alias(name) for name, c in known.items()])
    )
    scored = (
        grid.join(cells, ["time_step", "segment_id"], "left")
        .withColumns({name: F.coalesce(name, c) for name, c in vacant.items()})
        .withColumn("_final", weighted_sum(weights))
    )
    return scored.select(
        "time_step",
        "seg_no",
        "segment_id",
        F.col("_lidar").alias("lidar_geometry_risk"),
        F.col("_graph").alias("graph_risk_score"),
        "methane_risk_score",
        "raw_methane_risk_score",
        "sensor_reliability_score",
        "worker_exposure_score",
        exact_round(F.col("_final"), 3).alias("final_segment_risk"),
        risk_level(F.col("_final")).alias("risk_level"),
        F.coalesce("_workers", empty).alias("active_worker_ids"),
        F.coalesce("_sensors", empty).alias("active_sensor_ids"),
        as_map({"lidar": F.col("_lidar_reason"), "graph": F.col("_graph_reason"), "gas": F.col("_gas"), "worker": F.col("_worker")}).alias("reason_breakdown"),
    )


# Service field, pipeline field, older field.
RISK_ALIASES = (
    ("final_risk_score", "final_segment_risk", "final_risk_score"),
    ("geometry_risk", "lidar_geometry_risk", "geometry_risk"),
    ("environmental_risk", "methane_risk_score", "environmental_risk"),
    ("worker_exposure_risk", "worker_exposure_score", "worker_exposure_risk"),
    ("route_blockage_risk", "graph_risk_score", "route_blockage_risk"),
)


def risk_view(risks: DataFrame) -> DataFrame:
    """Risk rows as the service shows them (already filtered by step)."""
    view = canonical_record(risks)
    fields = {}
    for name, first, second in RISK_ALIASES:
        present = [F.col(c) for c in (first, second) if c in view.columns]
        fields[name] = F.coalesce(*present, F.lit(0.0))
    if "reason_breakdown" in view.columns:
        fields["active_reasons"] = active_reasons(F.col("reason_breakdown"))
    else:
        fields["active_reasons"] = F.array().cast("array<string>")
    return view.withColumns(fields)


def risk_by_segment(risks: DataFrame) -> DataFrame:
    """The last step's row of every segment."""
    view = risk_view(risks)
    return view.groupBy("segment_id").agg(
        F.max_by("final_risk_score", "time_step").alias("final_risk_score"),
        F.max("time_step").alias("time_step"),
    )
