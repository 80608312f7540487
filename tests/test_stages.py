"""Timelines, features, fusion, events and views on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adit import schemas
from adit.operators import anomaly, events, fusion, gas, geometry, reliability, segments, steps, workers
from adit.plans.pipeline import Inputs, Pipeline, Settings


@pytest.fixture(scope="module")
def line(spark):
    """Four segments from the exit 3 outwards, then a side branch."""
    rows = [(0, "3", "1", "5", ""), (1, "1", "2", "7", "Chokepoint"), (2, "2", "4", "3", ""), (3, "1", "5", "9", "")]
    df = spark.createDataFrame(rows, "row_no bigint, FROM string, TO string, LENGTH string, NOTES string")
    return segments.build_segments(df).cache()


def test_slice_features_match_plain_statistics(spark):
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.uniform(0, 30, 300), [0.0, 100.0, 70.0]])
    ys, zs = np.round(rng.normal(0, 5, len(xs)), 2), np.round(rng.normal(2, 1, len(xs)), 2)
    df = spark.createDataFrame([tuple(map(float, p)) for p in zip(xs, ys, zs)], "x double, y double, z double")
    rows = {r.slice_index: r for r in geometry.slice_features(df, 10).collect()}
    assert sorted(rows) == list(range(10))
    bins = np.minimum(9, (xs / 10).astype(int))
    for i, r in rows.items():
        mine = bins == i
        assert r.point_count == mine.sum() and math.isclose(r.bbox_width_x, 10.0)
        if not mine.any():
            assert r.width_proxy == r.ceiling_roughness == r.centroid_y == 0.0
            continue
        y, z = ys[mine], zs[mine]
        top = z[z >= np.percentile(z, 75) - 1e-12]
        expected = {
            "bbox_width_y": np.ptp(y),
            "centroid_x": xs[mine].mean(),
            "centroid_z": z.mean(),
            "width_proxy": np.percentile(y, 95) - np.percentile(y, 5),
            "ceiling_z_p95": np.percentile(z, 95),
            "ceiling_roughness": top.std(ddof=1) if len(top) > 1 else 0.0,
        }
        for name, value in expected.items():
            assert math.isclose(r[name], value, abs_tol=1e-9), (i, name)


def test_one_place_is_one_slice(spark, line):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    features = geometry.slice_features(df, 3)
    rows = {r.slice_index: r for r in geometry.geometry_risk(features, line).collect()}
    assert [rows[i].point_count for i in range(3)] == [1, 0, 0]
    # No range anywhere: narrow and low count fully, roughness and change not at all.
    assert {r.lidar_geometry_risk for r in rows.values()} == {55.0}


def test_geometry_change_and_segment_cycle(spark, line):
    schema = "slice_index int, point_count bigint, bbox_width_x double, bbox_width_y double, bbox_height_z double, " + ", ".join(
        f"{c} double"
        for c in "centroid_x centroid_y centroid_z width_proxy height_proxy ceiling_z_p95 floor_z_p05 ceiling_roughness".split()
    )
    shapes = [(2.0, 1.0, 0.1), (4.0, 1.0, 0.3), (0.0, 0.0, 0.0), (4.0, 3.0, 0.2), (2.0, 3.0, 0.3)]
    data = [(i, 0 if i == 2 else 5, 1.0, 1.0, 1.0, i * 1.0, 0.0, 0.0, w, h, 0.0, 0.0, r) for i, (w, h, r) in enumerate(shapes)]
    features = spark.createDataFrame(data, schema)
    rows = {r.slice_index: r for r in geometry.geometry_risk(features, line).collect()}
    assert rows[4].segment_id == "SEG_001" and rows[3].segment_id == "SEG_004"
    assert rows[0].geometry_change_score == 0.0 and rows[1].geometry_change_score == 50.0
    # The empty slice keeps its zeros, clamped against the others' range.
    assert rows[2].narrowness_score == 100.0 and rows[2].geometry_change_score == 100.0
    assert rows[2].ceiling_roughness_score == 0.0
    none = geometry.geometry_risk(features, line.where("false")).collect()
    assert {r.segment_id for r in none} == {f"SLICE_{i:03d}" for i in range(5)}
    at = {r.segment_id: r.x for r in geometry.segment_positions(geometry.geometry_risk(features, line)).collect()}
    assert at["SEG_001"] == 4.0


def test_worker_timeline(spark, line):
    rows = [
        ("a", 0, "0", "0", "0", "3", "4", "0"),
        ("a", 1, "9", "9", "9", "0", "0", "0"),
        ("a", 2, "0.001", "bad", "", "0", "0", "0"),
        ("a", 4, "10", "0", "0", "20", "0", "0"),
        ("a", 6, "5", "0", "0", "0", "0", "1"),
        ("a", 8, "4.5", "0", "0", "0", "0", "1"),
        ("b", 0, "2.5", "0", None, "0", "0", "0"),
    ]
    schema = "worker_id string, row_idx bigint, " + ", ".join(f"{c} string" for c in schemas.TRACKS)
    got = {
        (r.worker_id, r.time_step): (r.mapped_segment_id, r.motion_status, r.acc_magnitude)
        for r in workers.worker_timeline(spark.createDataFrame(rows, schema), line, 5).collect()
    }
    assert got == {
        ("a", 0): ("SEG_001", "moving", 5.0),
        ("a", 1): ("SEG_001", "still", 0.0),
        ("a", 2): ("SEG_004", "possible_fall", 20.0),
        ("a", 3): ("SEG_003", "fast_motion", 1.0),
        ("a", 4): ("SEG_002", "moving", 1.0),
        ("b", 0): ("SEG_002", "moving", 0.0),
    }


def test_gas_timeline(spark, line):
    rows = [(i, str(v), None if i % 2 else "x", str(v)) for i, v in enumerate([0.3, 0.6, 0.9, 1.2, 3.0])]
    readings = spark.createDataFrame(rows, "row_idx bigint, MM252 string, MM261 string, MM211 string")
    means = gas.row_mean(readings)
    values = sorted(r.methane for r in means.collect())
    assert np.allclose(values, [0.2, 0.4, 0.6, 0.8, 2.0])
    norm = gas.normaliser(means).first()
    assert math.isclose(norm.normaliser, np.percentile(values, 99)) and math.isclose(norm.max_value, 2.0)
    got = gas.gas_timeline(means, segments.place_sensors(line), 2).orderBy("time_step").collect()
    assert [(r.time_step, r.sensor_id, r.segment_id, r.status) for r in got] == [
        (0, "GAS_SENSOR_01", "SEG_002", "normal"), (1, "GAS_SENSOR_01", "SEG_002", "medium"),
    ]


@pytest.mark.parametrize(("values", "expected"), [([0.0] * 200 + [5.0], 5.0), ([0.0, 0.0], 0.0), ([], 1.0)])
def test_gas_normaliser_falls_back(spark, values, expected):
    means = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_idx bigint, methane double")
    assert gas.normaliser(means).first().normaliser == expected


def test_reliability(spark):
    lines = [
        ("batch1.dat", "1;10.0 1:5"), ("batch1.dat", "2;30.0 1:5"), ("batch1.dat", "2;oops 1:5"),
        ("batch10.dat", "1;5.0 1:1"), ("batch2.dat", "noise"), ("batch2.dat", "3;7 1:1"), ("batch2.dat", "3;7;9 1:1"),
    ]
    parsed = reliability.parse_drift_lines(spark.createDataFrame(lines, "file_name string, line string"))
    batches = reliability.drift_batches(parsed)
    got = {r.file_name: r for r in batches.collect()}
    assert got["batch1.dat"].class_counts == {"1": 1, "2": 2} and got["batch1.dat"].rows_scanned == 2
    assert math.isclose(got["batch1.dat"].concentration_stdev, 200**0.5)
    assert got["batch10.dat"].concentration_stdev == 0.0 and got["batch2.dat"].rows_scanned == 1
    rows = sorted(map(tuple, reliability.sensor_reliability(batches).drop("batch_summary", "interpretation").collect()))
    assert rows == [
        ("GAS_SENSOR_01", "batch1.dat", 65.0, True, 35.0),
        ("GAS_SENSOR_02", "batch10.dat", 100.0, False, 0.0),
        ("GAS_SENSOR_03", "batch2.dat", 100.0, False, 0.0),
    ]


def frames(spark, gas_rows, worker_rows, reliability_rows=()):
    g = spark.createDataFrame([(t, s, seg, 0.1, r, "x", "p") for t, s, seg, r in gas_rows], schemas.GAS)
    w = spark.createDataFrame([(t, w, (0.0, 0.0, 0.0), s, 1.0, m) for t, w, s, m in worker_rows], schemas.WORKERS)
    r = spark.createDataFrame([(s, "b", v, False, 0.0, "i", None) for s, v in reliability_rows], schemas.RELIABILITY)
    return g, w, r


def fused_of(spark, line, gas_rows, worker_rows, reliability_rows=(), shape=(("SEG_001", 40.0), ("SEG_001", 50.0))):
    g, w, r = frames(spark, gas_rows, worker_rows, reliability_rows)
    s = spark.createDataFrame(list(shape), "segment_id string, lidar_geometry_risk double")
    k = spark.createDataFrame([("SEG_001", 80.0), ("SEG_002", 10.0)], "segment_id string, graph_risk_score double")
    return fusion.fuse(line, s, k, w, g, r), w


def test_fusion_is_dense_and_adds_up(spark, line):
    gas_rows = [(0, "A", "SEG_002", 50.0), (0, "B", "SEG_002", 90.0), (2, "A", "SEG_001", 10.0)]
    worker_rows = [(0, "w1", "SEG_002", "moving"), (0, "w2", "SEG_002", "moving"), (1, "w1", "SEG_001", "moving")]
    df, _ = fused_of(spark, line, gas_rows, worker_rows, [("A", 70.0), ("A", 60.0), ("B", 90.0)])
    rows = {(r.time_step, r.segment_id): r for r in df.collect()}
    assert len(rows) == 3 * 4
    r = rows[0, "SEG_002"]
    assert (r.raw_methane_risk_score, r.sensor_reliability_score, r.methane_risk_score) == (90.0, 60.0, 58.5)
    assert r.active_worker_ids == ["w1", "w2"] and r.active_sensor_ids == ["A", "B"] and r.worker_exposure_score == 100.0
    assert math.isclose(r.final_segment_risk, 0.25 * 10 + 0.25 * 58.5 + 15, abs_tol=1e-3)
    r = rows[1, "SEG_001"]
    assert r.lidar_geometry_risk == 50.0 and math.isclose(r.final_segment_risk, 0.35 * 50 + 20 + 15)
    assert rows[2, "SEG_004"].final_segment_risk == 0.0 and rows[2, "SEG_004"].reason_breakdown["worker"].startswith("no active")


def test_event_prefers_critical_then_earliest(spark):
    schema = schemas.FUSED
    base = (0.0,) * 6
    def row(t, n, risk, lvl):
        return (t, n, f"SEG_{n:03d}", *base, risk, lvl, [], [], {})
    ties = spark.createDataFrame([row(3, 2, 58.5, "MEDIUM"), (*row(1, 2, 58.5, "MEDIUM"),), row(1, 1, 58.5, "MEDIUM")], schema)
    e = events.pick_event(ties).first()
    assert (e.time_step, e.segment_id, e.scenario_basis) == (1, "SEG_001", "no_critical_segment_detected_in_local_safe_pass")
    crit = ties.unionByName(spark.createDataFrame([row(9, 3, 20.0, "CRITICAL")], schema))
    assert events.pick_event(crit).first().segment_id == "SEG_003"
    assert events.pick_event(ties.where("false")).collect() == []
    assert [r.time_step for r in events.top_risks(ties, 2).collect()] == [1, 1]


def test_scenario_and_playback(spark, line):
    # The event is w1 in SEG_002; w2 stands beyond it, w3 beside it.
    worker_rows = [(0, "w1", "SEG_001", "moving"), (1, "w1", "SEG_002", "still"), (0, "w2", "SEG_003", "moving"), (0, "w3", "SEG_004", "moving")]
    df, w = fused_of(spark, line, [(1, "A", "SEG_002", 100.0), (2, "A", "SEG_002", 0.0)], worker_rows, shape=[("SEG_002", 90.0)])
    df = df.cache()
    scenario = events.emergency_scenario(line, w, df, "3").cache()
    got = {r.worker_id: (r.time_step, r.exit_reachable_after_blockage, r.alternative_route_to_exit, r.emergency_status) for r in scenario.collect()}
    assert got == {
        "w1": (1, False, None, "WORKER_INSIDE_HIGHEST_RISK_SEGMENT_STRESS_TEST"),
        "w2": (1, False, None, "STRESS_TEST_NO_ROUTE_AVAILABLE"),
        "w3": (1, True, ["1", "3"], "STRESS_TEST_ALTERNATIVE_ROUTE_AVAILABLE"),
    }
    states = events.worker_playback(w, scenario, steps.max_time_step(df)).cache()
    seen = {(r.worker_id, r.time_step): tuple(r)[2:] for r in states.collect()}
    assert seen["w1", 2] == ("SEG_002", "trapped", "WORKER_TRAPPED_AFTER_EVENT")
    assert seen["w1", 1] == ("SEG_002", "trapped", "HIGHEST_RISK_SEGMENT_ROUTE_STRESS_TEST")
    assert seen["w3", 2] == ("SEG_004", "moving", "WORKER_FOLLOWING_ALTERNATIVE_ROUTE")
    assert seen["w1", 0] == ("SEG_001", "moving", "NORMAL_TIMELINE")
    trail = {(r.worker_id, r.time_step): r.trail for r in events.worker_trail(states).collect()}
    assert trail["w1", 2] == ["SEG_001", "SEG_002", "SEG_002"]
    panel = {(r.worker_id, r.time_step): r for r in events.playback_panel(df, w, scenario).collect()}
    assert panel["w1", 0].blocked_segment is None and panel["w1", 1].blocked_segment == "SEG_002"
    assert panel["w2", 1].top_segment == "SEG_002" and panel["w2", 1].exit_reachable is False
    view = events.collapse_view(scenario).where("worker_id = 'w2'").first()
    assert (view.blocked_segment, view.event.segment_id, view.event.risk_level) == ("S002", "S002", "high")


def test_scenario_without_workers(spark, line):
    df, w = fused_of(spark, line, [(0, "A", "SEG_002", 100.0)], [])
    r = events.emergency_scenario(line, w, df, "3").first()
    assert r.worker_id is None and r.worker_segment == r.blocked_segment
    assert r.exit_reachable_after_blockage is False


def test_time_step_selection(spark):
    df = spark.createDataFrame([(2, "a"), (5, "b"), (5, "c")], "time_step int, v string")
    assert {r.v for r in steps.at_time_step(df, 5).collect()} == {"b", "c"}
    assert {r.v for r in steps.at_time_step(df, 0).collect()} == {"a"}
    assert steps.at_time_step(df, None) is df
    plain = df.drop("time_step")
    assert steps.at_time_step(plain, 3) is plain
    assert [steps.parse_time_step(x) for x in (None, "", "ALL", "7")] == [0, 0, None, 7]
    assert df.where("false").select(steps.max_time_step(df.where("false")).alias("m")).collect() == []
    assert spark.range(1).select(steps.max_time_step(df.where("false")).alias("m")).first().m == 0


def test_views_fill_defaults_and_aliases(spark):
    w = spark.createDataFrame([("SEG_047", "fast_motion"), ("S9", "still")], "mapped_segment_id string, motion_status string")
    got = [(r.current_segment, r.position_reliability, r.status) for r in workers.worker_view(w).collect()]
    assert got == [("S047", 0.78, "safe"), ("S009", 0.86, "safe")]
    kept = workers.worker_view(w.withColumn("status", F.lit("hurt")).withColumn("position_reliability", F.lit(0.5))).first()
    assert (kept.status, kept.position_reliability) == ("hurt", 0.5)
    r = spark.createDataFrame([("7", 3.0, "HIGH")], "segment_id string, geometry_risk double, risk_level string")
    v = fusion.risk_view(r).first()
    assert (v.segment_id, v.geometry_risk, v.final_risk_score, v.risk_level, v.active_reasons) == ("S007", 3.0, 0.0, "high", [])


def test_stillness_zscore_and_trend(spark):
    motion = "still still moving still still still".split()
    w = spark.createDataFrame([("a", t, m) for t, m in enumerate(motion)], "worker_id string, time_step int, motion_status string")
    assert [tuple(r) for r in anomaly.still_periods(w, 3).collect()] == [("a", 3, 5, 3)]
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = sorted(r.zscore for r in anomaly.zscore(v, "k", "v").collect())
    assert np.allclose(got, [-(0.5**0.5), 0.0, 0.5**0.5])
    f = spark.createDataFrame([("s", t, 2.0 * t + 1) for t in range(4)] + [("q", 0, 1.0)], "segment_id string, time_step int, final_segment_risk double")
    assert {r.segment_id: round(r.risk_slope, 9) for r in anomaly.risk_trend(f).collect()} == {"s": 2.0, "q": 0.0}


def test_pipeline_end_to_end(spark):
    edges = spark.createDataFrame(
        [(0, "3", "1", "5", ""), (1, "1", "2", "7", "chokepoint"), (2, "2", "3", "3", "")],
        "row_no bigint, FROM string, TO string, LENGTH string, NOTES string",
    )
    points = spark.range(500).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("z"))
    tracks = spark.range(60).select(
        F.lit("WORKER_01").alias("worker_id"), F.col("id").alias("row_idx"), (F.col("id") / 10).alias("pose_x"),
        *[F.lit(0.0).alias(c) for c in schemas.TRACKS[1:]],
    )
    readings = spark.range(90).select(F.col("id").alias("row_idx"), (F.col("id") / 90).alias("MM263"))
    drift = spark.createDataFrame([("batch1.dat", "1;1.0 1:2"), ("batch1.dat", "1;3.0 1:2")], "file_name string, line string")
    p = Pipeline(Inputs(edges, points, tracks, readings, drift), Settings(slice_count=6))
    assert p.fused.count() == 90 * 3
    assert p.scenario.count() == 1 and p.playback().count() == 90
    assert p.segment_view().first().segment_id.startswith("S0")
    assert p.worker_view(75).first().time_step == 0 and p.worker_view(3).first().time_step == 3
    nodes, edges_ = p.graph_view()
    assert {r.node_id for r in nodes.where("is_exit").collect()} == {"3"} and edges_.count() == 3
    asks = spark.createDataFrame(
        [("q", "WORKER_01", 2, None, None)], "request_id string, worker_id string, time_step int, segment_id string, blocked_segment string"
    )
    answer = p.route_answers(asks).first()
    assert answer.worker_id == "WORKER_01" and answer.reachable is not None


def test_reasons_of_a_segment_are_written_before_the_steps(spark, line):
    df, _ = fused_of(spark, line, [(9, "A", "SEG_002", 50.0)], [(0, "w1", "SEG_002", "moving")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # A plan is printed from its end to its beginning.
    assert plan.index("Generate explode(sequence(") < plan.index("LiDAR geometry risk")
    assert {r.reason_breakdown["gas"] for r in df.where("time_step = 1").collect()} == {"Methane risk 0.0, confidence-adjusted 0.0"}


def test_playback_sends_no_table_to_the_driver(spark, line):
    _, w = fused_of(spark, line, [], [(0, "w1", "SEG_001", "moving"), (1, "w1", "SEG_002", "moving")])
    event = "struct<event_type: string>"
    fate = spark.createDataFrame([(1, "w1", "SEG_002", True, ("E",))], f"time_step int, worker_id string, worker_segment string, exit_reachable_after_blockage boolean, event {event}")
    states = events.worker_playback(w, fate, F.lit(2))
    assert len(states.collect()) == 3
    assert "Broadcast" not in states._jdf.queryExecution().executedPlan().toString()
