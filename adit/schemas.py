"""Explicit schemas of everything that is read from files."""

from __future__ import annotations

# Column names of the input files.
EDGE_LIST = ("FROM", "TO", "LENGTH", "NOTES")
TRACKS = ("pose_x", "pose_y", "pose_z", "acc_x", "acc_y", "acc_z")
POINTS = "point_idx bigint, x double, y double, z double"
STORED_POINTS = "point_idx bigint, x float, y float, z float"
SEGMENTS = (
    "seg_no bigint, segment_id string, from_node string, to_node string, length double, "
    "notes string, is_chokepoint boolean"
)
ANCHORS = "anchor_id string, node_id string, segment_id string, placement_reason string"
WORKERS = (
    "time_step int, worker_id string, uwb_pose struct<x: double, y: double, z: double>, "
    "mapped_segment_id string, acc_magnitude double, motion_status string"
)
GAS = (
    "time_step int, sensor_id string, segment_id string, methane_value double, "
    "methane_risk_score double, status string, placement_reason string"
)
RELIABILITY = (
    "sensor_id string, source_batch string, sensor_reliability_score double, drift_warning boolean, "
    "sensor_anomaly_score double, interpretation string, batch_summary struct<file: string, "
    "rows_scanned: bigint, class_counts: map<string, bigint>, concentration_mean: double, "
    "concentration_stdev: double>"
)
GRAPH_RISK = (
    "seg_no bigint, segment_id string, from_node string, to_node string, length double, "
    "is_chokepoint boolean, disconnected_node_count bigint, total_node_count bigint, "
    "graph_blocking_score double, chokepoint_score double, length_score double, "
    "graph_risk_score double, risk_level string"
)
FUSED = (
    "time_step int, seg_no bigint, segment_id string, lidar_geometry_risk double, "
    "graph_risk_score double, methane_risk_score double, raw_methane_risk_score double, "
    "sensor_reliability_score double, worker_exposure_score double, final_segment_risk double, "
    "risk_level string, active_worker_ids array<string>, active_sensor_ids array<string>, "
    "reason_breakdown map<string, string>"
)
HEADER = (
    "signature string, version string, header_size int, offset_to_points bigint, point_format int, "
    "record_length int, point_count bigint, scales array<double>, offsets array<double>, "
    "mins array<double>, maxs array<double>"
)
