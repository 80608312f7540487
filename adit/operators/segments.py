"""Tunnel segments, their nodes, and where anchors and gas sensors go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.text import canonical_record, canonical_segment_id, numbered, strip, to_float
from adit.operators.indexing import ordered_index
from adit.workspace import one_row

JUNCTION_DEGREE = 3
SENSOR_COUNT = 3


def build_segments(edges: DataFrame) -> DataFrame:
    """Edge rows (row_no from 0, FROM, TO, LENGTH, NOTES) to segments."""
    notes = F.coalesce(strip(F.col("NOTES")), F.lit(""))
    return edges.select(
        (F.col("row_no") + 1).cast("bigint").alias("seg_no"),
        numbered("SEG_", 3, F.col("row_no") + 1).alias("segment_id"),
        strip(F.coalesce(F.col("FROM"), F.lit(""))).alias("from_node"),
        strip(F.coalesce(F.col("TO"), F.lit(""))).alias("to_node"),
        to_float(F.col("LENGTH")).alias("length"),
        notes.alias("notes"),
        F.lower(notes).contains("chokepoint").alias("is_chokepoint"),
    )


def nodes(segments: DataFrame) -> DataFrame:
    """Distinct endpoints."""
    return segments.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()


def node_degree(segments: DataFrame) -> DataFrame:
    """Edge ends per node; a self loop has two."""
    ends = segments.select(F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


# Reasons of a placement.
AT_EXIT, AT_JUNCTION, AT_CHOKEPOINT = "exit_node", "junction", "chokepoint_segment"
SENSOR_REASON = "chokepoint_or_long_segment"


def place_anchors(segments: DataFrame, exit_node: str) -> DataFrame:
    """Exit and junction nodes by (name length, name), then chokepoint segments."""
    is_exit = F.col("node_id") == exit_node
    at_nodes = (
        node_degree(segments)
        .where(is_exit | (F.col("degree") >= JUNCTION_DEGREE))
        .select(
            F.lit(0).alias("_kind"),
            F.length("node_id").alias("_len"),
            F.lit(0).cast("bigint").alias("_seg"),
            "node_id",
            F.lit(None).cast("string").alias("segment_id"),
            F.when(is_exit, AT_EXIT).otherwise(AT_JUNCTION).alias("placement_reason"),
        )
    )
    at_chokepoints = segments.where("is_chokepoint").select(
        F.lit(1).alias("_kind"),
        F.lit(0).alias("_len"),
        F.col("seg_no").alias("_seg"),
        F.col("from_node").alias("node_id"),
        "segment_id",
        F.lit(AT_CHOKEPOINT).alias("placement_reason"),
    )
    placed = ordered_index(
        at_nodes.unionByName(at_chokepoints), ["_kind", "_len", "_seg", "node_id"], out="_no", start=1
    )
    return placed.select(
        numbered("ANCHOR_", 2, F.col("_no")).alias("anchor_id"), "node_id", "segment_id", "placement_reason"
    )


def place_sensors(segments: DataFrame, count: int = SENSOR_COUNT) -> DataFrame:
    """The first chokepoint segments or, without any, the longest ones."""
    has_chokepoint = F.coalesce(one_row(segments, F.max("is_chokepoint").alias("any"))["any"], F.lit(False))
    chosen = (
        segments.withColumn("_any", has_chokepoint)
        .where(F.col("is_chokepoint") | ~F.col("_any"))
        .withColumn("_first", F.when(F.col("_any"), F.lit(0.0)).otherwise(-F.col("length")))
        .orderBy("_first", "seg_no")
        .limit(count)
    )
    # The window sees the ``count`` rows of the limit, nothing more.
    number = F.row_number().over(Window.orderBy("_first", "seg_no"))
    return chosen.select(
        numbered("GAS_SENSOR_", 2, number).alias("sensor_id"),
        "segment_id",
        F.lit(SENSOR_REASON).alias("placement_reason"),
    )


def segment_view(segments: DataFrame) -> DataFrame:
    """Segments as the service shows them: canonical ids, default columns."""
    view = canonical_record(segments)
    defaults = {"is_blocked": F.lit(False), "source": F.lit("sample")}
    return view.withColumns({c: v for c, v in defaults.items() if c not in view.columns})


def graph_view(segments: DataFrame, exit_node: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with an exit flag, edges) of the tunnel graph."""
    view = segment_view(segments)
    node_rows = nodes(view).select("node_id", (F.col("node_id") == exit_node).alias("is_exit"))
    edge_rows = view.select(
        canonical_segment_id(F.col("segment_id")).alias("segment_id"),
        F.col("from_node").cast("string").alias("from_node"),
        F.col("to_node").cast("string").alias("to_node"),
        (F.col("length") if "length" in view.columns else F.lit(1.0)).alias("length"),
        (
            F.coalesce(F.col("is_chokepoint"), F.lit(False)) if "is_chokepoint" in view.columns else F.lit(False)
        ).alias("is_chokepoint"),
    )
    return node_rows, edge_rows
