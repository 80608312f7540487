"""The whole analysis as a chain of written stage tables.

Each stage is a property that is computed on first use and kept as a table
in the shared folder, so later stages (and other questions to the same
pipeline) start from it instead of recomputing their inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from adit.operators import events, fusion, gas, geometry, graph, reliability, routing, segments, steps, workers
from adit.workspace import materialize


@dataclass(frozen=True)
class Settings:
    # Default run parameters.
    exit_node: str = "3"
    slice_count: int = 49
    worker_steps: int = 90
    gas_steps: int = 90
    methane_columns: tuple[str, ...] = gas.METHANE_COLUMNS


@dataclass(frozen=True)
class Inputs:
    """edges (row_no, FROM, TO, LENGTH, NOTES), points (x, y, z), tracks
    (worker_id, row_idx, pose_*, acc_*), readings (row_idx, methane columns),
    drift_lines (file_name, line)."""

    edges: DataFrame
    points: DataFrame
    tracks: DataFrame
    readings: DataFrame
    drift_lines: DataFrame


class Pipeline:
    def __init__(self, inputs: Inputs, settings: Settings = Settings()):
        self.inputs = inputs
        self.settings = settings

    @cached_property
    def segments(self) -> DataFrame:
        return materialize(segments.build_segments(self.inputs.edges), "segments")

    @cached_property
    def sensors(self) -> DataFrame:
        return materialize(segments.place_sensors(self.segments), "sensors")

    @cached_property
    def anchors(self) -> DataFrame:
        return materialize(segments.place_anchors(self.segments, self.settings.exit_node), "anchors")

    @cached_property
    def event(self) -> DataFrame:
        return materialize(events.pick_event(self.fused), "event")

    @cached_property
    def slices(self) -> DataFrame:
        return materialize(geometry.slice_features(self.inputs.points, self.settings.slice_count), "slices")

    @cached_property
    def geometry(self) -> DataFrame:
        return materialize(geometry.geometry_risk(self.slices, self.segments), "geometry")

    @cached_property
    def impact(self) -> DataFrame:
        return materialize(graph.edge_impact(self.segments, self.settings.exit_node), "impact")

    @cached_property
    def graph(self) -> DataFrame:
        return materialize(graph.graph_risk(self.segments, self.impact), "graph")

    @cached_property
    def workers(self) -> DataFrame:
        s = self.settings
        return materialize(
            workers.worker_timeline(self.inputs.tracks, self.segments, s.worker_steps), "workers"
        )

    @cached_property
    def methane(self) -> DataFrame:
        return gas.row_mean(self.inputs.readings, self.settings.methane_columns)

    @cached_property
    def gas(self) -> DataFrame:
        s = self.settings
        return materialize(gas.gas_timeline(self.methane, self.sensors, s.gas_steps), "gas")

    @cached_property
    def batches(self) -> DataFrame:
        return materialize(reliability.drift_batches(reliability.parse_drift_lines(self.inputs.drift_lines)), "batches")

    @cached_property
    def reliability(self) -> DataFrame:
        return materialize(reliability.sensor_reliability(self.batches), "reliability")

    @cached_property
    def fused(self) -> DataFrame:
        return materialize(
            fusion.fuse(self.segments, self.geometry, self.graph, self.workers, self.gas, self.reliability), "fused"
        )

    @cached_property
    def scenario(self) -> DataFrame:
        return materialize(
            events.emergency_scenario(self.segments, self.workers, self.fused, self.settings.exit_node), "scenario"
        )

    # Service views

    def segment_view(self) -> DataFrame:
        return segments.segment_view(self.segments)

    def graph_view(self) -> tuple[DataFrame, DataFrame]:
        return segments.graph_view(self.segments, self.settings.exit_node)

    def worker_view(self, time_step: int | None = 0) -> DataFrame:
        return workers.worker_view(steps.at_time_step(self.workers, time_step))

    def risk_view(self, time_step: int | None = 0) -> DataFrame:
        return fusion.risk_view(steps.at_time_step(self.fused, time_step))

    def gas_view(self, time_step: int | None = 0) -> DataFrame:
        return fusion.canonical_record(steps.at_time_step(self.gas, time_step))

    def collapse_view(self) -> DataFrame:
        return events.collapse_view(self.scenario)

    def resolve(self, asks: DataFrame) -> DataFrame:
        return routing.resolve_requests(asks, self.worker_view(None), self.collapse_block())

    def collapse_block(self) -> DataFrame:
        """The blocked segment of the collapse result, one row."""
        return self.collapse_view().select("blocked_segment").limit(1)

    def route_answers(self, asks: DataFrame, exit_node: str | None = None) -> DataFrame:
        """Answers to route requests, weighed with the fused risk of their step."""
        risks = fusion.risk_view(self.fused).select("time_step", "segment_id", "final_risk_score")
        resolved = materialize(self.resolve(asks), "asks")
        return routing.answer_requests(
            self.segment_view(), resolved, exit_node or self.settings.exit_node, risks
        )

    def playback(self) -> DataFrame:
        return events.playback_panel(self.fused, self.workers, self.scenario)
