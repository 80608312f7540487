"""The registered queries: every operator run over the whole test tables.

Nested results are flattened to text here, so that they compare as plain
columns; the operators themselves return arrays, maps and structs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit import schemas
from adit.functions import scores, text
from adit.operators import anomaly, events, fusion, gas, geometry, graph, nearest, reliability, routing
from adit.operators import sampling, segments, steps
from adit.plans import jobs, testtables
from adit.plans.pipeline import Pipeline
from adit.sources import files, las, published, tables
from adit.workspace import materialize, new_path

EXIT = testtables.SETTINGS.exit_node


_pipelines: dict[tuple[str, str], Pipeline] = {}


def stages(spark: SparkSession, sf_dir: str) -> Pipeline:
    """One pipeline per application and folder, its stages shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _pipelines:
        _pipelines[key] = testtables.pipeline(spark, sf_dir)
    return _pipelines[key]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: scores.exact_round(F.col(c), digits) for c, t in df.dtypes if t == "double"})


def joined(c: str):
    return F.array_join(c, ">").alias(c)


# Columns and sources


def q_segments(spark, sf):
    return stages(spark, sf).segments


def q_node_degree(spark, sf):
    return segments.node_degree(stages(spark, sf).segments)


def q_anchors(spark, sf):
    return segments.place_anchors(stages(spark, sf).segments, EXIT)


def q_sensor_placement(spark, sf):
    return stages(spark, sf).sensors


def q_sensor_placement_longest(spark, sf):
    plain = stages(spark, sf).segments.withColumn("is_chokepoint", F.lit(False))
    return segments.place_sensors(plain)


def q_id_normalize(spark, sf):
    return testtables.segment_spellings(spark, sf).select(
        "id", text.canonical_segment_id(F.col("raw_id")).alias("segment_id")
    )


def q_record_normalize(spark, sf):
    raw = testtables.segment_spellings(spark, sf).select(
        "id",
        F.col("raw_id").alias("segment_id"),
        F.col("raw_id").alias("blocked_segment"),
        F.when(F.col("id") % 2 == 0, F.lit(" HIGH ")).otherwise(F.lit("Medium")).alias("risk_level"),
    )
    return text.canonical_record(raw)


def q_float_coercion(spark, sf):
    part = testtables.table(spark, sf, "part")
    key = F.col("p_partkey")
    raw = (
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 3 == 0, F.col("p_brand"))
        .when(key % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_retailprice").cast("string"))
    )
    return part.select("p_partkey", text.to_float(raw).alias("value"))


def q_risk_bands(spark, sf):
    customer = testtables.table(spark, sf, "customer")
    span = customer.agg(F.struct(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).alias("s")).scalar()
    score = scores.normalize(F.col("c_acctbal"), span["lo"], span["hi"])
    inverse = scores.normalize_inverse(F.col("c_acctbal"), span["lo"], span["hi"])
    return customer.select(
        "c_custkey",
        scores.exact_round(score, 6).alias("score"),
        scores.exact_round(inverse, 6).alias("inverse_score"),
        scores.clamp(F.col("c_acctbal")).alias("clamped"),
        scores.risk_level(score).alias("risk_level"),
        scores.gas_status(score).alias("status"),
    )


def q_human_size(spark, sf):
    size = (F.pow(F.col("o_totalprice"), 2) * F.pow(F.lit(10.0), F.col("o_orderkey") % 6 - 3)).cast("bigint")
    return testtables.table(spark, sf, "orders").select(
        "o_orderkey", size.alias("size_bytes"), text.human_size(size).alias("size")
    )


def q_time_step_filter(spark, sf):
    """A step that occurs, the fallback for one that never does, no step named, and all of them."""
    rows = stages(spark, sf).workers
    asked = [steps.at_time_step(rows, steps.parse_time_step(raw)).withColumn("asked", F.lit(raw)) for raw in ("3", "100000", "", "All")]
    return reduce(DataFrame.unionByName, asked).select("asked", "time_step", "worker_id", "mapped_segment_id")


def q_csv_source(spark, sf):
    """Segments from a written CSV: file order decides the numbers."""
    path = new_path(spark, "edges-csv")
    tables.write_csv(testtables.edge_rows(spark, sf).orderBy("row_no").drop("row_no"), path)
    return segments.build_segments(tables.read_edges(spark, path)).drop("segment_id")


def q_json_source(spark, sf):
    path = new_path(spark, "segments-json")
    tables.write_json(stages(spark, sf).segments, path)
    lines = tables.read_json_lines(spark, path, schemas.SEGMENTS)
    absent = tables.read_json(spark, path + "-absent", schemas.SEGMENTS, default_empty=True)
    return lines.unionByName(absent)


def q_json_document(spark, sf):
    """The sensors through one JSON array; a top-k result, so the document is small."""
    path = new_path(spark, "sensors-json")
    sensors = stages(spark, sf).sensors
    records = F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n")
    sensors.agg(F.concat(F.lit("["), records, F.lit("]")).alias("value")).write.text(path)
    schema = ", ".join(f"{c} {t}" for c, t in sensors.dtypes)
    return tables.read_json(spark, path, schema)


def q_drift_text_source(spark, sf):
    path = new_path(spark, "drift")
    testtables.drift_lines(spark, sf).write.partitionBy("file_name").text(path)
    lines = tables.read_drift_lines(spark, path, pattern="file_name=batch*.dat")
    return reliability.parse_drift_lines(lines).groupBy("file_name", "class").agg(
        F.count(F.lit(1)).alias("rows"), F.count("concentration").alias("parsed")
    )


def _las_folder(spark, sf):
    path = new_path(spark, "las")
    las.write_las(las_cloud(spark, sf), path)
    return path


def las_cloud(spark, sf):
    return testtables.table(spark, sf, "lineitem").select(
        F.lit(0).cast("bigint").alias("point_idx"),
        (F.col("l_extendedprice") / 100).alias("x"),
        F.col("l_quantity").alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )


def q_las_numbering(spark, sf):
    """Record numbers run through all files without a gap."""
    points = las.read_las(spark, _las_folder(spark, sf), partition_records=7_000)
    return points.agg(
        F.min("point_idx").alias("first"), F.max("point_idx").alias("last"), F.count_distinct("point_idx").alias("numbers")
    )


def q_las_window_sample(spark, sf):
    """Windows read from written files; ranges of the table become files in name order, so numbers follow the table."""
    path = new_path(spark, "las-sample")
    points = testtables.numbered_cloud(spark, sf)
    las.write_las(points.repartitionByRange("point_idx").sortWithinPartitions("point_idx"), path)
    total = las.point_total(path)
    sample = las.read_las(spark, path, ranges=sampling.window_ranges(spark, total, total // 4))
    return sample.select("point_idx", *[scores.exact_round(F.col(c), 2).alias(c) for c in "xyz"])


def q_las_scan(spark, sf):
    points = las.read_las(spark, _las_folder(spark, sf), partition_records=100_000)
    return points.groupBy(F.round("y", 2).alias("y"), F.round("z", 2).alias("z")).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 2).alias("sum_x")
    )


def q_las_headers(spark, sf):
    listing = files.list_files(spark, _las_folder(spark, sf))
    summary = las.header_summary(listing, schemas.HEADER)
    return summary.agg(
        F.sum("header.point_count").alias("points"),
        F.round(F.min(F.col("header.mins")[1]), 2).alias("min_y"),
        F.round(F.max(F.col("header.maxs")[1]), 2).alias("max_y"),
        F.count("error").alias("errors"),
    )


def q_stored_points(spark, sf):
    path = new_path(spark, "points")
    tables.write_points(testtables.numbered_cloud(spark, sf), path)
    return tables.read_points(spark, path).select(
        "point_idx", *[scores.exact_round(F.col(c).cast("double"), 2).alias(c) for c in "xyz"]
    )


def _batch_files(spark, sf):
    """One text file per drift batch, in a folder of its own."""
    path = new_path(spark, "batches")
    lines = testtables.drift_lines(spark, sf)
    lines.repartition("file_name").write.partitionBy("file_name").text(path)
    return path


def q_inventory(spark, sf):
    listing = files.list_files(spark, _batch_files(spark, sf), "/no/such/root")
    return files.by_extension(listing, (".txt", *files.TRACKED_EXTENSIONS))


def q_expected_sources(spark, sf):
    """Every batch's folder is found, and none under a name that was not written."""
    root = _batch_files(spark, sf)
    names = testtables.drift_lines(spark, sf).select("file_name").distinct()
    key = F.explode(F.array("file_name", F.concat("file_name", F.lit(".gone"))))
    expected = names.select(key.alias("key"), F.lit("batch").alias("label"))
    expected = expected.withColumn("path", F.concat(F.lit(f"{root}/file_name="), "key"))
    return files.expected_status(expected, files.list_files(spark, root)).select("key", "label", "exists")


def q_published_timeline(spark, sf):
    fused = stages(spark, sf).fused
    zones = {name: new_path(spark, name) for name in ("ready", "served")}
    published.publish(fused, *zones.values(), partition_by="time_step")
    back = [published.read_published(spark, path, schemas.FUSED).withColumn("zone", F.lit(zone)) for zone, path in zones.items()]
    return back[0].unionByName(back[1]).groupBy("zone", "time_step").agg(
        F.count(F.lit(1)).alias("rows"), F.max("final_segment_risk").alias("top_risk")
    )


def q_served_step(spark, sf):
    """One step from its own folder: one that occurs, the fallback for one that never does, and all of them."""
    zone = new_path(spark, "served-steps")
    published.publish(stages(spark, sf).fused, zone, partition_by="time_step")
    asked = {"7": 7, "100000": 100_000, "all": None}
    rows = [published.read_step(spark, zone, schemas.FUSED, step).withColumn("asked", F.lit(name)) for name, step in asked.items()]
    return reduce(DataFrame.unionByName, rows).select("asked", "time_step", "segment_id", "final_segment_risk", "risk_level")


# Sampling


def q_decimate(spark, sf):
    s = testtables.SETTINGS
    return sampling.decimate(testtables.tracks(spark, sf), s.worker_steps).select(
        "worker_id", "time_step", "pose_x", "pose_y"
    )


def q_point_decimation(spark, sf):
    return sampling.every_nth(testtables.numbered_cloud(spark, sf), 500)


def q_window_sample(spark, sf):
    points = testtables.numbered_cloud(spark, sf)
    total = points.count()
    return sampling.window_sample(points, total, total // 4).select("sample_idx", "point_idx", "x")


def q_point_limit(spark, sf):
    return sampling.first_points(testtables.numbered_cloud(spark, sf), 5000)


def q_point_bounds(spark, sf):
    return rounded(sampling.point_bounds(testtables.cloud(spark, sf)))


def q_sample_bounds(spark, sf):
    points = testtables.numbered_cloud(spark, sf)
    total = points.count()
    sample = sampling.window_sample(points, total, total // 4)
    return rounded(jobs.sample_summary(sample, total, total // 4).drop("sampling_method", "target_point_count"))


def q_large_files(spark, sf):
    """The three largest batches."""
    listing = files.list_files(spark, _batch_files(spark, sf)).where("extension = '.txt'")
    return files.large_files(listing, k=3, at_least=0).select("size_bytes", "size", "extension")


# Features


def q_slice_features(spark, sf):
    return rounded(stages(spark, sf).slices)


def q_geometry_risk(spark, sf):
    return stages(spark, sf).geometry.select(
        "segment_id", "slice_index", *scores.GEOMETRY_WEIGHTS, "lidar_geometry_risk", "risk_level"
    )


def q_segment_positions(spark, sf):
    return geometry.segment_positions(stages(spark, sf).geometry)


def q_point_density(spark, sf):
    return rounded(geometry.point_density(stages(spark, sf).slices))


def q_worker_timeline(spark, sf):
    return stages(spark, sf).workers.select(
        "time_step",
        "worker_id",
        F.col("uwb_pose.x").alias("pose_x"),
        F.col("uwb_pose.y").alias("pose_y"),
        "mapped_segment_id",
        "acc_magnitude",
        "motion_status",
        "source_row_policy",
    )


def q_gas_row_mean(spark, sf):
    return rounded(stages(spark, sf).methane)


def q_gas_normaliser(spark, sf):
    return rounded(gas.normaliser(stages(spark, sf).methane))


def q_gas_timeline(spark, sf):
    return stages(spark, sf).gas


def q_drift_batches(spark, sf):
    counts = F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return stages(spark, sf).batches.select(
        "file_name",
        "rows_scanned",
        F.array_join(F.array_sort(counts), ",").alias("class_counts"),
        scores.exact_round(F.col("concentration_mean"), 3).alias("concentration_mean"),
        scores.exact_round(F.col("concentration_stdev"), 3).alias("concentration_stdev"),
    )


def q_reliability(spark, sf):
    return stages(spark, sf).reliability.drop("batch_summary")


# Graph


def q_adjacency(spark, sf):
    return graph.adjacency(stages(spark, sf).segments, "SEG_003").drop("seg_no")


def q_reachable(spark, sf):
    return graph.reachable_nodes(stages(spark, sf).segments, EXIT, "SEG_003")


def q_unreached(spark, sf):
    rows = stages(spark, sf).segments
    return graph.unreached_nodes(rows, graph.reachable_nodes(rows, EXIT, "SEG_003"))


def q_edge_impact(spark, sf):
    return stages(spark, sf).impact.select(
        "segment_id", "disconnected_node_count", "total_node_count"
    )


def q_graph_risk(spark, sf):
    return stages(spark, sf).graph.drop("seg_no")


def q_hop_route(spark, sf):
    """From every node, with the third segment blocked."""
    rows = stages(spark, sf).segments
    asks = segments.nodes(rows).select(
        F.col("node_id").alias("request_id"), F.col("node_id").alias("start_node"), F.lit("SEG_003").alias("blocked_segment")
    )
    return routing.hop_routes(rows, asks, EXIT).select("start_node", "blocked_segment", joined("route_nodes"))


def q_weighted_route(spark, sf):
    """Lowest-cost tree from the exit, unblocked, at every step's risk."""
    p = stages(spark, sf)
    risks = p.fused.select("time_step", "segment_id", F.col("final_segment_risk").alias("final_risk_score"))
    edges = materialize(routing.risk_edges(p.segments, risks, risks.select("time_step").distinct()), "weighted")
    tree = routing.cost_trees(edges, EXIT)
    return tree.select(
        "time_step", "node", scores.exact_round(F.col("cost"), 3).alias("cost"), "hops", "parent", "parent_segment"
    )


def _asks(spark, sf):
    """One request per worker and step; each worker asks about its own blockage."""
    p = stages(spark, sf)
    count = p.segments.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = p.worker_view(None).select("worker_id", "time_step")
    blocked = text.numbered("S", 3, F.col("worker_id").cast("bigint") % count + 1)
    return rows.select(
        F.concat_ws("@", "worker_id", F.col("time_step").cast("string")).alias("request_id"),
        "worker_id",
        "time_step",
        F.lit(None).cast("string").alias("segment_id"),
        F.when(F.col("worker_id").cast("bigint") % 3 != 0, blocked).alias("blocked_segment"),
    )


def q_route_requests(spark, sf):
    return stages(spark, sf).resolve(_asks(spark, sf))


def q_emergency_route(spark, sf):
    answers = stages(spark, sf).route_answers(_asks(spark, sf))
    return answers.select(
        "worker_id",
        "time_step",
        "reachable",
        "trapped",
        "reason",
        "start_segment",
        "blocked_segment",
        "exit_node",
        joined("route_segments"),
        joined("route_nodes"),
        "total_cost",
    )


def q_critical_scenario(spark, sf):
    """The scenario of doubled risks, which reach the critical band."""
    p = stages(spark, sf)
    doubled = F.col("final_segment_risk") * 2
    hot = p.fused.withColumns({"final_segment_risk": F.least(F.lit(100.0), doubled), "risk_level": scores.risk_level(doubled)})
    return _flat_scenario(events.emergency_scenario(p.segments, p.workers, hot, EXIT))


def q_emergency_scenario(spark, sf):
    return _flat_scenario(stages(spark, sf).scenario)


def _flat_scenario(scenario):
    return scenario.select(
        "time_step",
        "worker_id",
        "worker_segment",
        "blocked_segment",
        "exit_node",
        "exit_reachable_after_blockage",
        joined("alternative_route_to_exit"),
        "emergency_status",
        "scenario_basis",
        F.col("event.event_type").alias("event_type"),
        F.col("event.final_segment_risk").alias("event_risk"),
    )


def q_graph_nodes(spark, sf):
    return stages(spark, sf).graph_view()[0]


def q_graph_edges(spark, sf):
    return stages(spark, sf).graph_view()[1]


# Fusion and playback


def _flat_fused(df):
    return df.select(
        "time_step",
        "segment_id",
        "lidar_geometry_risk",
        "graph_risk_score",
        "methane_risk_score",
        "raw_methane_risk_score",
        "sensor_reliability_score",
        "worker_exposure_score",
        "final_segment_risk",
        "risk_level",
        F.array_join("active_worker_ids", ",").alias("active_worker_ids"),
        F.array_join("active_sensor_ids", ",").alias("active_sensor_ids"),
        F.col("reason_breakdown")["lidar"].alias("lidar_reason"),
        F.col("reason_breakdown")["graph"].alias("graph_reason"),
        F.col("reason_breakdown")["gas"].alias("gas_reason"),
        F.col("reason_breakdown")["worker"].alias("worker_reason"),
    )


def q_fused_timeline(spark, sf):
    return _flat_fused(stages(spark, sf).fused)


def q_fusion_alternative(spark, sf):
    p = stages(spark, sf)
    fused = fusion.fuse(
        p.segments, p.geometry, p.graph, p.workers, p.gas, p.reliability, scores.ALTERNATIVE_FUSION_WEIGHTS
    )
    return fused.select("time_step", "segment_id", "final_segment_risk", "risk_level")


def q_top_risks(spark, sf):
    return events.top_risks(stages(spark, sf).fused, 10).select("time_step", "segment_id", "final_segment_risk")


def q_topk_per_step(spark, sf):
    return events.top_risks_per_step(stages(spark, sf).fused).select(
        "time_step", "rank", "segment_id", "final_segment_risk"
    )


def q_gas_first_k(spark, sf):
    return events.first_gas_per_step(stages(spark, sf).gas).select("time_step", "rank", "sensor_id", "segment_id")


def q_event(spark, sf):
    return events.pick_event(stages(spark, sf).fused).drop("reason_breakdown")


def q_workers_at_event(spark, sf):
    """The workers' rows at a step beyond most tracks."""
    return events.workers_at(stages(spark, sf).workers, F.lit(33))


def q_worker_playback(spark, sf):
    p = stages(spark, sf)
    return events.worker_playback(p.workers, p.scenario, steps.max_time_step(p.fused))


def q_worker_trail(spark, sf):
    p = stages(spark, sf)
    states = events.worker_playback(p.workers, p.scenario, steps.max_time_step(p.fused))
    return events.worker_trail(states).select("worker_id", "time_step", joined("trail"))


def q_playback_panel(spark, sf):
    return stages(spark, sf).playback().select(
        "time_step",
        "worker_id",
        "worker_segment",
        "motion_status",
        "top_segment",
        "top_risk",
        "top_level",
        "blocked_segment",
        "exit_reachable",
        "scenario_code",
        joined("alternative_route_to_exit"),
    )


# Views


def q_view_segments(spark, sf):
    return stages(spark, sf).segment_view()


def q_view_workers(spark, sf):
    return stages(spark, sf).worker_view(6).select(
        "time_step", "worker_id", "current_segment", "mapped_segment_id", "position_reliability", "status",
        F.col("position.x").alias("position_x"),
    )


def q_view_risks(spark, sf):
    return stages(spark, sf).risk_view(6).select(
        "time_step",
        "segment_id",
        "risk_level",
        "final_risk_score",
        "geometry_risk",
        "environmental_risk",
        "worker_exposure_risk",
        "route_blockage_risk",
        F.array_join("active_reasons", "; ").alias("reasons"),
    )


def q_view_gas(spark, sf):
    return stages(spark, sf).gas_view(6)


def q_view_collapse(spark, sf):
    return stages(spark, sf).collapse_view().select(
        "worker_id",
        "worker_segment",
        "blocked_segment",
        F.col("event.segment_id").alias("event_segment"),
        F.col("event.risk_level").alias("event_level"),
    )


def q_risk_by_segment(spark, sf):
    return fusion.risk_by_segment(stages(spark, sf).fused)


# Anomaly indicators


def q_gas_threshold(spark, sf):
    return anomaly.threshold_flag(stages(spark, sf).gas, "methane_value", 40.0).select(
        "time_step", "sensor_id", "methane_value", "above_threshold"
    )


def q_zscore(spark, sf):
    """Events as readings, their type as the sensor."""
    rows = testtables.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(anomaly.zscore(rows, "event_type", "value"))


def q_rolling_mean(spark, sf):
    rows = testtables.tracks(spark, sf).select("worker_id", "row_idx", F.col("pose_x").alias("value"))
    return rounded(anomaly.rolling(rows, "worker_id", "row_idx", "value", 4))


def q_anomaly_score(spark, sf):
    scored = anomaly.gas_anomalies(stages(spark, sf).gas, 40.0, 3, 50.0)
    # A mean of four six-digit values can end in a tie at six digits.
    return scored.select(
        "time_step",
        "sensor_id",
        scores.exact_round(F.col("zscore"), 6).alias("zscore"),
        F.round("rolling_mean", 9).alias("rolling_mean"),
        scores.exact_round(F.col("rolling_change"), 6).alias("rolling_change"),
        scores.exact_round(F.col("anomaly_score"), 6).alias("anomaly_score"),
    )


def q_nearest_segment(spark, sf):
    p = stages(spark, sf)
    centres = p.geometry.join(p.segments.select("segment_id", "seg_no"), "segment_id").select(
        "segment_id", "seg_no", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("centroid_z").alias("z")
    )
    positions = testtables.numbered_cloud(spark, sf).withColumnRenamed("point_idx", "pos_id")
    return rounded(nearest.nearest_segment(positions, centres).select("pos_id", "segment_id", "distance"))


def q_stillness(spark, sf):
    return anomaly.still_periods(stages(spark, sf).workers, 1)


def q_risk_trend(spark, sf):
    return rounded(anomaly.risk_trend(stages(spark, sf).fused))


def q_worker_status(spark, sf):
    p = stages(spark, sf)
    answers = p.route_answers(_asks(spark, sf))
    return routing.worker_status(p.worker_view(None), answers).select("worker_id", "time_step", "current_segment", "status")


def registered():
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
