"""DuckDB SQL with the same meaning as each registered query.

Written from the definitions, not from the Spark plans: where the Spark side
shares one search, counts values or splits work, the SQL takes the plain way
(a search per removed segment, sorted values, all pairs).
"""

from __future__ import annotations

# Named views over the test tables; a query lists the ones it ends in.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *deps: str, sql: str) -> None:
    VIEWS[name] = (deps, sql)


def expand_rounding(sql: str) -> str:
    """``rnd(x, d)`` as correctly rounded decimal rounding of the double."""
    while "rnd(" in sql:
        at = sql.rindex("rnd(")
        depth, comma = 1, None
        for i in range(at + 4, len(sql)):
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            if depth == 0:
                break
        value, digits = sql[at + 4 : comma], int(sql[comma + 1 : i])
        sql = f"{sql[:at]}(CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE) + 0.0){sql[i + 1:]}"
    return sql


def compose(deps: tuple[str, ...], final: str) -> str:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for d in VIEWS[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{final}"


view("edges", sql="""
  SELECT CAST(row_number() OVER (ORDER BY kind, a) AS BIGINT) AS seg_no, CAST(a AS VARCHAR) AS from_node,
         CAST(b AS VARCHAR) AS to_node, len AS length, notes
  FROM (SELECT 0 AS kind, s_suppkey AS a, CAST(floor(s_suppkey / 2) AS BIGINT) AS b, abs(s_acctbal) / 100 AS len,
               CASE WHEN s_nationkey % 10 = 0 THEN 'chokepoint' ELSE '' END AS notes
        FROM supplier WHERE s_suppkey > 0
        UNION ALL
        SELECT 1, s_suppkey, CAST(floor(s_suppkey / 4) AS BIGINT), abs(s_acctbal) / 50, ''
        FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey >= 4)""")
view("segments", "edges", sql="""
  SELECT seg_no, printf('SEG_%03d', seg_no) AS segment_id, from_node, to_node, length, notes,
         contains(lower(notes), 'chokepoint') AS is_chokepoint FROM edges""")
view("arcs", "segments", sql="""
  SELECT from_node AS src, to_node AS dst, seg_no, segment_id, CASE WHEN length = 0 THEN 1.0 ELSE length END AS length
  FROM segments
  UNION ALL
  SELECT to_node, from_node, seg_no, segment_id, CASE WHEN length = 0 THEN 1.0 ELSE length END FROM segments""")
view("node_set", "arcs", sql="SELECT DISTINCT src AS node_id FROM arcs")
view("degrees", "arcs", sql="SELECT src AS node_id, count(*) AS degree FROM arcs GROUP BY src")
view("sensors", "segments", sql="""
  SELECT printf('GAS_SENSOR_%02d', row_number() OVER (ORDER BY seg_no)) AS sensor_id, segment_id,
         'chokepoint_or_long_segment' AS placement_reason
  FROM (SELECT * FROM segments WHERE is_chokepoint ORDER BY seg_no LIMIT 3)""")
view("spellings", sql="""
  SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN ' no digits '
       WHEN p_partkey % 3 = 0 THEN concat('SEG_', CAST(p_partkey AS VARCHAR))
       WHEN p_partkey % 2 = 0 THEN concat(' S', CAST(p_partkey AS VARCHAR), ' ')
       ELSE CAST(p_partkey AS VARCHAR) END AS raw_id FROM part""")
view("canonical", "spellings", sql="""
  SELECT id, CASE WHEN raw_id IS NULL THEN NULL WHEN regexp_matches(trim(raw_id), '[0-9]+$')
       THEN printf('S%03d', CAST(regexp_extract(trim(raw_id), '([0-9]+)$', 1) AS BIGINT)) ELSE trim(raw_id) END AS segment_id
  FROM spellings""")
view("numbered_cloud", sql="""
  SELECT event_id AS point_idx, value AS x, user_id * CAST(0.25 AS DOUBLE) AS y, CAST(length(event_type) AS DOUBLE) AS z FROM events""")

# Geometry
view("cloud", sql="SELECT l_extendedprice / 100 AS x, l_quantity AS y, l_discount * 100 + l_tax * 100 AS z FROM lineitem")
view("cloud_span", "cloud", sql="SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 49 AS width FROM cloud")
view("sliced", "cloud", "cloud_span", sql="""
  SELECT CASE WHEN width > 0 THEN least(48, greatest(0, CAST(trunc((x - lo) / width) AS INTEGER))) ELSE 0 END AS slice_index, x, y, z
  FROM cloud, cloud_span""")
view("slice_top", "sliced", sql="SELECT slice_index, quantile_cont(z, 0.75) AS p75 FROM sliced GROUP BY slice_index")
view("slice_rough", "sliced", "slice_top", sql="""
  SELECT s.slice_index, coalesce(stddev_samp(z), 0.0) AS rough FROM sliced s JOIN slice_top t USING (slice_index)
  WHERE z >= p75 GROUP BY s.slice_index""")
view("slices", "sliced", "slice_rough", "cloud_span", sql="""
  SELECT CAST(i AS INTEGER) AS slice_index, coalesce(n, 0) AS point_count, (SELECT width FROM cloud_span) AS bbox_width_x,
         coalesce(bw, 0.0) AS bbox_width_y, coalesce(bh, 0.0) AS bbox_height_z, coalesce(cx, 0.0) AS centroid_x,
         coalesce(cy, 0.0) AS centroid_y, coalesce(cz, 0.0) AS centroid_z, coalesce(wp, 0.0) AS width_proxy,
         coalesce(hp, 0.0) AS height_proxy, coalesce(z95, 0.0) AS ceiling_z_p95, coalesce(z05, 0.0) AS floor_z_p05,
         coalesce(rough, 0.0) AS ceiling_roughness
  FROM range(49) r(i)
  LEFT JOIN (SELECT slice_index, count(*) AS n, max(y) - min(y) AS bw, max(z) - min(z) AS bh, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
               quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS wp, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS hp,
               quantile_cont(z, 0.95) AS z95, quantile_cont(z, 0.05) AS z05 FROM sliced GROUP BY slice_index) f ON f.slice_index = i
  LEFT JOIN slice_rough q ON q.slice_index = i""")
view("shape_span", "slices", sql="""
  SELECT min(width_proxy) AS lw, max(width_proxy) AS hw, min(height_proxy) AS lh, max(height_proxy) AS hh,
         min(ceiling_roughness) AS lr, max(ceiling_roughness) AS hr FROM slices WHERE point_count > 0""")
view("shape_scores", "slices", "shape_span", sql="""
  SELECT s.*,
    CASE WHEN hw <= lw THEN 100.0 ELSE 100.0 - greatest(0.0, least(100.0, (width_proxy - lw) / (hw - lw) * 100.0)) END AS narrowness_score,
    CASE WHEN hh <= lh THEN 100.0 ELSE 100.0 - greatest(0.0, least(100.0, (height_proxy - lh) / (hh - lh) * 100.0)) END AS low_ceiling_score,
    CASE WHEN hr <= lr THEN 0.0 ELSE greatest(0.0, least(100.0, (ceiling_roughness - lr) / (hr - lr) * 100.0)) END AS ceiling_roughness_score,
    greatest(0.0, least(100.0, (abs(width_proxy - coalesce(lag(width_proxy) OVER o, width_proxy))
      + abs(height_proxy - coalesce(lag(height_proxy) OVER o, height_proxy)))
      / (CASE WHEN (hw - lw) + (hh - lh) = 0 THEN 1.0 ELSE (hw - lw) + (hh - lh) END) * 100.0)) AS geometry_change_score
  FROM slices s, shape_span WINDOW o AS (ORDER BY slice_index)""")
view("geometry", "shape_scores", "segments", sql="""
  SELECT g.segment_id, s.*, 0.30 * narrowness_score + 0.25 * low_ceiling_score + 0.25 * ceiling_roughness_score
    + 0.20 * geometry_change_score AS risk
  FROM shape_scores s JOIN segments g ON g.seg_no = s.slice_index % (SELECT count(*) FROM segments) + 1""")

# Workers
view("tracks", sql="""
  SELECT CAST(user_id AS VARCHAR) AS worker_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
    CAST(floor(value / 5) AS DOUBLE) AS pose_x, floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 50) AS pose_y,
    CAST(0 AS DOUBLE) AS pose_z, value / 15 AS acc_x, CAST(0 AS DOUBLE) AS acc_y, CAST(1 AS DOUBLE) AS acc_z FROM events""")
view("sampled", "tracks", sql="""
  SELECT CAST(row_idx // step_rows AS INTEGER) AS time_step, * FROM tracks,
    (SELECT CAST(ceil((max(row_idx) + 1) / 90.0) AS BIGINT) AS step_rows FROM tracks) WHERE row_idx % step_rows = 0""")
view("moves", "sampled", "segments", sql="""
  SELECT *, lag(pose_x) OVER w AS px, lag(pose_y) OVER w AS py, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc,
    (SELECT min(pose_x) FROM sampled) AS lo, (SELECT max(pose_x) FROM sampled) AS hi, (SELECT count(*) FROM segments) AS n
  FROM sampled WINDOW w AS (PARTITION BY worker_id ORDER BY time_step)""")
view("workers", "moves", "segments", sql="""
  SELECT time_step, worker_id, pose_x, pose_y, segment_id AS mapped_segment_id, rnd(acc, 4) AS acc_magnitude,
    CASE WHEN px IS NULL THEN 'moving' WHEN acc > 18.0 THEN 'possible_fall'
         WHEN sqrt((px - pose_x) * (px - pose_x) + (py - pose_y) * (py - pose_y)) < 0.01 THEN 'still'
         WHEN sqrt((px - pose_x) * (px - pose_x) + (py - pose_y) * (py - pose_y)) > 1.5 THEN 'fast_motion'
         ELSE 'moving' END AS motion_status,
    'first_of_every_' || CAST(step_rows AS VARCHAR) || '_rows' AS source_row_policy
  FROM moves JOIN segments
    ON seg_no = least(n - 1, greatest(0, CAST(trunc((pose_x - lo) / greatest(hi - lo, 1e-9) * n) AS BIGINT))) + 1""")

# Gas and reliability
view("hours", sql="""
  SELECT date_trunc('hour', ts) AS h,
    avg(CASE WHEN event_type = 'click' THEN value END) AS m1, avg(CASE WHEN event_type = 'view' THEN value END) AS m2,
    avg(CASE WHEN event_type = 'error' THEN value END) AS m3, avg(CASE WHEN event_type = 'signup' THEN value END) AS m4,
    avg(CASE WHEN event_type = 'purchase' THEN value END) AS m5 FROM events GROUP BY 1""")
view("methane", "hours", sql="""
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS row_idx,
    (coalesce(m1, 0.0) + coalesce(m2, 0.0) + coalesce(m3, 0.0) + coalesce(m4, 0.0) + coalesce(m5, 0.0)) / 5 AS methane FROM hours""")
view("gas_norm", "methane", sql="""
  SELECT quantile_cont(methane, 0.99) AS p99, max(methane) AS max_value,
    coalesce(nullif(quantile_cont(methane, 0.99), 0), max(methane), 1.0) AS normaliser FROM methane""")
view("gas_raw", "methane", "gas_norm", "sensors", sql="""
  SELECT CAST(row_idx // step_rows AS INTEGER) AS time_step, sensor_id, segment_id, methane, placement_reason,
    greatest(0.0, least(100.0, methane / normaliser * 100.0)) AS risk
  FROM methane, gas_norm, sensors, (SELECT CAST(ceil((max(row_idx) + 1) / 90.0) AS BIGINT) AS step_rows FROM methane)
  WHERE row_idx % step_rows = 0""")
view("gas", "gas_raw", sql="""
  SELECT time_step, sensor_id, segment_id, rnd(methane, 6) AS methane_value, rnd(risk, 3) AS methane_risk_score,
    CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 30 THEN 'medium' ELSE 'normal' END AS status,
    placement_reason FROM gas_raw""")
view("drift", sql="""
  SELECT concat('batch', CAST(p AS VARCHAR), '.dat') AS file_name,
    CASE WHEN o_orderkey % 97 = 0 THEN 'malformed 1:0.5'
         ELSE concat(o_orderstatus, ';', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ' 1:0.5 2:0.7') END AS line
  FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) AS p FROM orders)""")
view("drift_parsed", "drift", sql="""
  SELECT file_name, split_part(split_part(line, ' ', 1), ';', 1) AS class,
    TRY_CAST(split_part(split_part(line, ' ', 1), ';', 2) AS DOUBLE) AS concentration
  FROM drift WHERE contains(split_part(line, ' ', 1), ';')""")
view("batch_stats", "drift_parsed", sql="""
  SELECT file_name, count(concentration) AS rows_scanned, coalesce(avg(concentration), 0.0) AS mean,
    coalesce(stddev_samp(concentration), 0.0) AS dev FROM drift_parsed GROUP BY file_name""")
view("batch_scores", "batch_stats", sql="""
  SELECT *, row_number() OVER (ORDER BY file_name) - 1 AS idx,
    greatest(45.0, 100.0 - (CASE WHEN (SELECT max(dev) FROM batch_stats) = 0 THEN 0.0
      ELSE dev / (SELECT max(dev) FROM batch_stats) END) * 35.0) AS score FROM batch_stats""")
view("reliability", "batch_scores", sql="""
  SELECT printf('GAS_SENSOR_%02d', idx % 3 + 1) AS sensor_id, file_name AS source_batch, rnd(score, 3) AS sensor_reliability_score,
    score < 70.0 AS drift_warning, rnd(100.0 - score, 3) AS sensor_anomaly_score,
    CASE WHEN score >= 70.0 THEN 'gas reading is considered reliable'
         ELSE 'drift/anomaly warning should reduce confidence' END AS interpretation FROM batch_scores""")

# Graph
view("cut_reach", "arcs", sql="""
  SELECT DISTINCT seg_no AS cut, '0' AS node FROM arcs
  UNION
  SELECT r.cut, a.dst FROM cut_reach r JOIN arcs a ON a.src = r.node AND a.seg_no <> r.cut""")
view("impact", "cut_reach", "segments", "node_set", sql="""
  SELECT s.seg_no, s.segment_id, (SELECT count(*) FROM node_set) - count(r.node) AS disconnected_node_count,
    (SELECT count(*) FROM node_set) AS total_node_count
  FROM segments s LEFT JOIN (SELECT * FROM cut_reach WHERE node IN (SELECT node_id FROM node_set)) r ON r.cut = s.seg_no
  GROUP BY s.seg_no, s.segment_id""")
view("graph_scores", "impact", "segments", sql="""
  SELECT s.*, disconnected_node_count, total_node_count,
    disconnected_node_count / greatest(1, total_node_count) * 100.0 AS blocking,
    CASE WHEN is_chokepoint THEN 100.0 ELSE 0.0 END AS choke,
    CASE WHEN (SELECT max(length) <= min(length) FROM segments) THEN 0.0 ELSE
      (length - (SELECT min(length) FROM segments)) / ((SELECT max(length) FROM segments) - (SELECT min(length) FROM segments)) * 100.0 END AS len_score
  FROM segments s JOIN impact i USING (seg_no)""")
view("graph_risk", "graph_scores", sql="""
  SELECT *, 0.60 * blocking + 0.25 * choke + 0.15 * len_score AS score FROM graph_scores""")
view("open_reach", "arcs", sql="""
  SELECT '0' AS node
  UNION
  SELECT a.dst FROM open_reach r JOIN arcs a ON a.src = r.node AND a.segment_id <> 'SEG_003'""")


def hop_views(prefix: str, blocked: str, *deps: str) -> None:
    """Distances from the exit without one segment, next nodes and routes."""
    view(f"{prefix}_walks", "arcs", "node_set", *deps, sql=f"""
      SELECT '0' AS node, 0 AS d
      UNION
      SELECT a.dst, w.d + 1 FROM {prefix}_walks w JOIN arcs a ON a.src = w.node
      WHERE a.segment_id <> {blocked} AND w.d < (SELECT count(*) FROM node_set)""")
    view(f"{prefix}_dist", f"{prefix}_walks", sql=f"SELECT node, min(d) AS d FROM {prefix}_walks GROUP BY node")
    view(f"{prefix}_next", f"{prefix}_dist", "arcs", *deps, sql=f"""
      SELECT a.node, min(x.dst) AS nxt FROM {prefix}_dist a JOIN arcs x ON x.src = a.node
      JOIN {prefix}_dist b ON b.node = x.dst AND b.d = a.d - 1 WHERE x.segment_id <> {blocked} GROUP BY a.node""")
    view(f"{prefix}_path", f"{prefix}_dist", f"{prefix}_next", sql=f"""
      SELECT node AS start, node AS here, node AS route FROM {prefix}_dist
      UNION ALL
      SELECT p.start, n.nxt, p.route || '>' || n.nxt FROM {prefix}_path p JOIN {prefix}_next n ON n.node = p.here""")
    view(f"{prefix}_routes", f"{prefix}_path", sql=f"SELECT start, route FROM {prefix}_path WHERE here = '0'")


hop_views("hop", "'SEG_003'")

# Fusion
view("gas_cells", "gas", "reliability", sql="""
  SELECT g.time_step, g.segment_id, max(methane_risk_score) AS methane,
    min(coalesce(r.rel, 100.0)) AS rel, string_agg(g.sensor_id, ',' ORDER BY g.sensor_id) AS sensors
  FROM gas g LEFT JOIN (SELECT sensor_id, min(sensor_reliability_score) AS rel FROM reliability GROUP BY sensor_id) r USING (sensor_id)
  GROUP BY g.time_step, g.segment_id""")
view("worker_cells", "workers", sql="""
  SELECT time_step, mapped_segment_id AS segment_id, string_agg(DISTINCT worker_id, ',' ORDER BY worker_id) AS people
  FROM workers GROUP BY 1, 2""")
view("shape_by_segment", "geometry", sql="""
  SELECT segment_id, greatest(0.0, max(rnd(risk, 3))) AS shape FROM geometry GROUP BY segment_id""")
view("grid", "segments", "workers", "gas", "shape_by_segment", "graph_risk", "gas_cells", "worker_cells", sql="""
  SELECT CAST(t.i AS INTEGER) AS time_step, s.seg_no, s.segment_id, coalesce(shape, 0.0) AS shape, coalesce(rnd(g.score, 3), 0.0) AS graph,
    coalesce(methane, 0.0) AS methane, coalesce(rel, 100.0) AS rel,
    coalesce(methane, 0.0) * greatest(0.65, coalesce(rel, 100.0) / 100.0) AS adjusted,
    CAST(CASE WHEN people IS NOT NULL THEN 100.0 ELSE 0.0 END AS DOUBLE) AS exposure, coalesce(people, '') AS people, coalesce(sensors, '') AS sensors
  FROM range((SELECT greatest((SELECT max(time_step) FROM workers), (SELECT max(time_step) FROM gas)) + 1)) t(i)
  CROSS JOIN segments s
  LEFT JOIN shape_by_segment sh ON sh.segment_id = s.segment_id
  LEFT JOIN graph_risk g ON g.segment_id = s.segment_id
  LEFT JOIN gas_cells c ON c.segment_id = s.segment_id AND c.time_step = t.i
  LEFT JOIN worker_cells w ON w.segment_id = s.segment_id AND w.time_step = t.i""")


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'CRITICAL' WHEN {score} >= 60 THEN 'HIGH' WHEN {score} >= 30 THEN 'MEDIUM' ELSE 'LOW' END"


view("fused", "grid", sql=f"""
  SELECT time_step, seg_no, segment_id, rnd(shape, 3) AS lidar_geometry_risk, rnd(graph, 3) AS graph_risk_score,
    rnd(adjusted, 3) AS methane_risk_score, rnd(methane, 3) AS raw_methane_risk_score, rnd(rel, 3) AS sensor_reliability_score,
    exposure AS worker_exposure_score, rnd(final, 3) AS final_segment_risk, {level('final')} AS risk_level,
    people AS active_worker_ids, sensors AS active_sensor_ids,
    printf('LiDAR geometry risk %.1f', shape) AS lidar_reason, printf('Graph blocking risk %.1f', graph) AS graph_reason,
    printf('Methane risk %.1f, confidence-adjusted %.1f', methane, adjusted) AS gas_reason,
    CASE WHEN exposure > 0 THEN 'worker is inside this segment' ELSE 'no active worker exposure' END AS worker_reason
  FROM (SELECT *, 0.35 * shape + 0.25 * graph + 0.25 * adjusted + 0.15 * exposure AS final FROM grid)""")
def last_known(step: str) -> str:
    return f"""
      SELECT worker_id, coalesce(max(CASE WHEN time_step = {step} THEN mapped_segment_id END),
        arg_max(mapped_segment_id, time_step)) AS worker_segment FROM workers GROUP BY worker_id"""


def scenario_views(prefix: str, fused: str) -> None:
    """The event of a risk table and what it does to every worker."""
    view(f"{prefix}event", fused, sql=f"""
      SELECT time_step, segment_id, risk_level, final_segment_risk,
        CASE WHEN risk_level = 'CRITICAL' THEN 'POTENTIAL_COLLAPSE_OR_UNSAFE_SEGMENT' ELSE 'HIGHEST_RISK_SEGMENT_ROUTE_STRESS_TEST' END AS event_type,
        CASE WHEN risk_level = 'CRITICAL' THEN 'critical_risk_threshold' ELSE 'no_critical_segment_detected_in_local_safe_pass' END AS scenario_basis
      FROM {fused} ORDER BY risk_level = 'CRITICAL' DESC, final_segment_risk DESC, time_step, seg_no LIMIT 1""")
    hop_views(f"{prefix}esc", f"(SELECT segment_id FROM {prefix}event)", f"{prefix}event")
    view(f"{prefix}at_event", "workers", f"{prefix}event", sql=last_known(f"(SELECT time_step FROM {prefix}event)"))
    view(f"{prefix}scenario", f"{prefix}at_event", f"{prefix}event", "segments", f"{prefix}esc_routes", sql=f"""
      SELECT e.time_step, a.worker_id, a.worker_segment, e.segment_id AS blocked_segment, '0' AS exit_node,
        a.worker_segment <> e.segment_id AND r.route IS NOT NULL AS exit_reachable_after_blockage,
        CASE WHEN a.worker_segment <> e.segment_id THEN r.route END AS alternative_route_to_exit,
        CASE WHEN e.risk_level = 'CRITICAL' AND a.worker_segment = e.segment_id THEN 'CRITICAL_WORKER_IN_BLOCKED_SEGMENT'
             WHEN e.risk_level = 'CRITICAL' AND r.route IS NOT NULL THEN 'ALTERNATIVE_ROUTE_AVAILABLE'
             WHEN e.risk_level = 'CRITICAL' THEN 'CRITICAL_WORKER_TRAPPED'
             WHEN a.worker_segment = e.segment_id THEN 'WORKER_INSIDE_HIGHEST_RISK_SEGMENT_STRESS_TEST'
             WHEN r.route IS NOT NULL THEN 'STRESS_TEST_ALTERNATIVE_ROUTE_AVAILABLE'
             ELSE 'STRESS_TEST_NO_ROUTE_AVAILABLE' END AS emergency_status,
        e.scenario_basis, e.event_type, e.final_segment_risk AS event_risk, e.risk_level AS event_level
      FROM {prefix}at_event a CROSS JOIN {prefix}event e LEFT JOIN segments s ON s.segment_id = a.worker_segment
      LEFT JOIN {prefix}esc_routes r ON r.start = s.from_node""")


scenario_views("", "fused")
# Doubled risks reach the critical band, which the plain ones need not.
view("hot_fused", "fused", sql=f"""
  SELECT * REPLACE (least(100.0, 2 * final_segment_risk) AS final_segment_risk, {level('2 * final_segment_risk')} AS risk_level) FROM fused""")
scenario_views("hot_", "hot_fused")
view("playback", "workers", "scenario", "fused", sql="""
  SELECT c.worker_id, CAST(t.i AS INTEGER) AS time_step,
    CASE WHEN t.i >= c.time_step AND NOT exit_reachable_after_blockage THEN worker_segment
         ELSE coalesce(w.mapped_segment_id, f.seg) END AS mapped_segment_id,
    CASE WHEN t.i >= c.time_step AND NOT exit_reachable_after_blockage THEN 'trapped'
         ELSE coalesce(w.motion_status, f.motion) END AS motion_status,
    CASE WHEN t.i < c.time_step THEN 'NORMAL_TIMELINE' WHEN t.i = c.time_step THEN event_type
         WHEN NOT exit_reachable_after_blockage THEN 'WORKER_TRAPPED_AFTER_EVENT'
         ELSE 'WORKER_FOLLOWING_ALTERNATIVE_ROUTE' END AS scenario_code
  FROM scenario c CROSS JOIN range((SELECT max(time_step) + 1 FROM fused)) t(i)
  LEFT JOIN workers w ON w.worker_id = c.worker_id AND w.time_step = t.i
  JOIN (SELECT worker_id, arg_min(mapped_segment_id, time_step) AS seg, arg_min(motion_status, time_step) AS motion
        FROM workers GROUP BY worker_id) f ON f.worker_id = c.worker_id""")


def short(c: str) -> str:
    return f"printf('S%03d', CAST(regexp_extract({c}, '([0-9]+)$', 1) AS BIGINT))"


# Routes: every request is one worker row; a third of them take the event's blockage.
view("asks", "workers", "segments", "event", sql=f"""
  SELECT worker_id || '@' || CAST(time_step AS VARCHAR) AS request_id, worker_id, time_step, {short('mapped_segment_id')} AS start_segment,
    CASE WHEN CAST(worker_id AS BIGINT) % 3 <> 0 THEN printf('S%03d', CAST(worker_id AS BIGINT) % (SELECT count(*) FROM segments) + 1)
         ELSE (SELECT {short('segment_id')} FROM event) END AS blocked_segment FROM workers""")
view("weights", "arcs", "fused", sql=f"""
  SELECT f.time_step, a.src, a.dst, a.seg_no, {short('a.segment_id')} AS seg, a.length + f.final_segment_risk * 0.20 AS w
  FROM arcs a JOIN fused f ON f.segment_id = a.segment_id WHERE a.src <> a.dst""")
# Label correcting over rounds; a round keeps the best (cost, hops) per node, staying put costs nothing.
view("situations", "asks", sql="SELECT DISTINCT time_step, blocked_segment FROM asks WHERE start_segment <> blocked_segment")


def cost_views(prefix: str, situations: str, *deps: str) -> None:
    view(f"{prefix}_moves", situations, "weights", "node_set", *deps, sql=f"""
      SELECT s.time_step, s.blocked_segment, w.src, w.dst, w.seg_no, w.seg, w.w, 1 AS h FROM {situations} s JOIN weights w USING (time_step)
      WHERE w.seg <> s.blocked_segment
      UNION ALL
      SELECT time_step, blocked_segment, node_id, node_id, 0, '', 0.0, 0 FROM {situations} CROSS JOIN node_set""")
    view(f"{prefix}_rounds", f"{prefix}_moves", "node_set", sql=f"""
      SELECT 0 AS k, time_step, blocked_segment, '0' AS node, {{'c': CAST(0.0 AS DOUBLE), 'h': 0}} AS best FROM {situations}
      UNION ALL
      SELECT k + 1, r.time_step, r.blocked_segment, m.dst, min({{'c': r.best.c + m.w, 'h': r.best.h + m.h}})
      FROM {prefix}_rounds r JOIN {prefix}_moves m ON m.time_step = r.time_step AND m.blocked_segment = r.blocked_segment AND m.src = r.node
      WHERE k < (SELECT count(*) FROM node_set) GROUP BY k, r.time_step, r.blocked_segment, m.dst""")
    view(f"{prefix}_costs", f"{prefix}_rounds", "node_set", sql=f"""
      SELECT time_step, blocked_segment, node, best.c AS cost, best.h AS hops FROM {prefix}_rounds WHERE k = (SELECT count(*) FROM node_set)""")
    view(f"{prefix}_parents", f"{prefix}_costs", f"{prefix}_moves", sql=f"""
      SELECT a.time_step, a.blocked_segment, a.node, a.cost, a.hops, min({{'n': m.dst, 's': m.seg_no, 'g': m.seg, 'w': m.w}}) AS up
      FROM {prefix}_costs a LEFT JOIN ({prefix}_moves m JOIN {prefix}_costs b
          ON b.time_step = m.time_step AND b.blocked_segment = m.blocked_segment AND b.node = m.dst)
        ON m.time_step = a.time_step AND m.blocked_segment = a.blocked_segment AND m.src = a.node AND m.h = 1
        AND a.cost = b.cost + m.w AND a.hops = b.hops + 1
      GROUP BY ALL""")


cost_views("esc2", "situations")
view("starts", "asks", "segments", "esc2_costs", sql=f"""
  SELECT request_id, time_step, blocked_segment, arg_min(node, {{'c': cost, 'r': rank}}) AS node, min(cost) AS cost
  FROM (SELECT a.request_id, a.time_step, a.blocked_segment, c.node, c.cost, CASE WHEN c.node = s.from_node THEN 0 ELSE 1 END AS rank
        FROM asks a JOIN segments s ON {short('s.segment_id')} = a.start_segment
        JOIN esc2_costs c ON c.time_step = a.time_step AND c.blocked_segment = a.blocked_segment AND c.node IN (s.from_node, s.to_node)
        WHERE a.start_segment <> a.blocked_segment)
  GROUP BY request_id, time_step, blocked_segment""")
view("route_walk", "starts", "esc2_parents", sql="""
  SELECT request_id, time_step, blocked_segment, CAST(0.0 AS DOUBLE) AS cost, node AS here, node AS nodes, '' AS segs FROM starts
  UNION ALL
  SELECT r.request_id, r.time_step, r.blocked_segment, r.cost + p.up.w, p.up.n, r.nodes || '>' || p.up.n,
    CASE WHEN r.segs = '' THEN p.up.g ELSE r.segs || '>' || p.up.g END
  FROM route_walk r JOIN esc2_parents p ON p.time_step = r.time_step AND p.blocked_segment = r.blocked_segment AND p.node = r.here
  WHERE r.here <> '0'""")
view("answers", "asks", "route_walk", sql="""
  SELECT a.worker_id, a.time_step, r.request_id IS NOT NULL AS reachable, r.request_id IS NULL AS trapped,
    CASE WHEN a.start_segment = a.blocked_segment THEN 'worker_segment_blocked' WHEN r.request_id IS NULL THEN 'no_route_to_exit'
         ELSE 'route_found' END AS reason,
    a.start_segment, a.blocked_segment, '0' AS exit_node, coalesce(r.segs, '') AS route_segments, coalesce(r.nodes, '') AS route_nodes,
    rnd(r.cost, 3) AS total_cost
  FROM asks a LEFT JOIN (SELECT * FROM route_walk WHERE here = '0') r USING (request_id)""")
view("every_step", "fused", sql="SELECT DISTINCT time_step, '' AS blocked_segment FROM fused")
cost_views("one", "every_step")

ORACLES: dict[str, str] = {}


def oracle(name: str, *deps: str, sql: str) -> None:
    ORACLES[name] = expand_rounding(compose(deps, sql))


oracle("segments", "segments", sql="SELECT seg_no, segment_id, from_node, to_node, length, notes, is_chokepoint FROM segments")
oracle("node_degree", "degrees", sql="SELECT node_id, degree FROM degrees")
oracle("anchors", "degrees", "segments", sql="""
  SELECT printf('ANCHOR_%02d', row_number() OVER (ORDER BY kind, len, seg, node_id)) AS anchor_id, node_id, segment_id, placement_reason
  FROM (SELECT 0 AS kind, length(node_id) AS len, 0 AS seg, node_id, CAST(NULL AS VARCHAR) AS segment_id,
               CASE WHEN node_id = '0' THEN 'exit_node' ELSE 'junction' END AS placement_reason
        FROM degrees WHERE node_id = '0' OR degree >= 3
        UNION ALL
        SELECT 1, 0, seg_no, from_node, segment_id, 'chokepoint_segment' FROM segments WHERE is_chokepoint)""")
oracle("sensor_placement", "sensors", sql="SELECT * FROM sensors")
oracle("sensor_placement_longest", "segments", sql="""
  SELECT printf('GAS_SENSOR_%02d', row_number() OVER (ORDER BY length DESC, seg_no)) AS sensor_id, segment_id,
         'chokepoint_or_long_segment' AS placement_reason
  FROM (SELECT * FROM segments ORDER BY length DESC, seg_no LIMIT 3)""")
oracle("id_normalize", "canonical", sql="SELECT id, segment_id FROM canonical")
oracle("record_normalize", "canonical", sql="""
  SELECT id, segment_id, segment_id AS blocked_segment, CASE WHEN id % 2 = 0 THEN 'high' ELSE 'medium' END AS risk_level FROM canonical""")
oracle("float_coercion", sql="""
  SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_brand
    WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE), 0.0) AS value FROM part""")
oracle("risk_bands", sql=f"""
  SELECT c_custkey, rnd(s, 6) AS score, rnd(100.0 - s, 6) AS inverse_score,
    greatest(0.0, least(100.0, c_acctbal)) AS clamped, {level('s')} AS risk_level,
    CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 30 THEN 'medium' ELSE 'normal' END AS status
  FROM (SELECT c_custkey, c_acctbal, (c_acctbal - (SELECT min(c_acctbal) FROM customer))
          / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)) * 100.0 AS s FROM customer)""")
oracle("human_size", sql="""
  SELECT o_orderkey, b AS size_bytes, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B'
    WHEN b / 1024 < 1024 THEN printf('%.1f KB', b / 1024)
    WHEN b / 1048576 < 1024 THEN printf('%.1f MB', b / 1048576)
    WHEN b / 1073741824 < 1024 THEN printf('%.1f GB', b / 1073741824)
    ELSE printf('%.1f TB', b / 1099511627776) END AS size
  FROM (SELECT o_orderkey, CAST(trunc(pow(o_totalprice, 2) * pow(10.0, o_orderkey % 6 - 3)) AS BIGINT) AS b FROM orders)""")
oracle("time_step_filter", "workers", sql="""
  SELECT asked, time_step, worker_id, mapped_segment_id FROM workers, (VALUES ('3'), ('100000'), (''), ('All')) a(asked)
  WHERE CASE asked WHEN '3' THEN time_step = 3 WHEN 'All' THEN true
    ELSE time_step = (SELECT min(time_step) FROM workers) END""")
oracle("csv_source", "segments", sql="SELECT seg_no, from_node, to_node, length, notes, is_chokepoint FROM segments")
oracle("json_source", "segments", sql="SELECT seg_no, segment_id, from_node, to_node, length, notes, is_chokepoint FROM segments")
oracle("json_document", "sensors", sql="SELECT * FROM sensors")
oracle("las_numbering", sql="""
  SELECT CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS numbers FROM lineitem""")
view("batch_bytes", "drift", sql="SELECT file_name, CAST(sum(strlen(line) + 1) AS BIGINT) AS b FROM drift GROUP BY file_name")
oracle("inventory", "batch_bytes", sql="""
  SELECT '.txt' AS extension, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM batch_bytes""")
oracle("expected_sources", "batch_bytes", sql="""
  SELECT file_name AS key, 'batch' AS label, true AS exists FROM batch_bytes
  UNION ALL SELECT file_name || '.gone', 'batch', false FROM batch_bytes""")
oracle("large_files", "batch_bytes", sql="""
  SELECT b AS size_bytes, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b / 1024 < 1024 THEN printf('%.1f KB', b / 1024)
    WHEN b / 1048576 < 1024 THEN printf('%.1f MB', b / 1048576) WHEN b / 1073741824 < 1024 THEN printf('%.1f GB', b / 1073741824)
    ELSE printf('%.1f TB', b / 1099511627776) END AS size, '.txt' AS extension FROM batch_bytes ORDER BY b DESC LIMIT 3""")
oracle("drift_text_source", "drift_parsed", sql="""
  SELECT file_name, class, count(*) AS rows, count(concentration) AS parsed FROM drift_parsed GROUP BY file_name, class""")
oracle("las_scan", sql="""
  SELECT rnd(l_quantity, 2) AS y, rnd(l_discount * 100, 2) AS z, count(*) AS points, rnd(sum(rint_x), 2) AS sum_x
  FROM (SELECT *, round_even(l_extendedprice / 100 / 0.01, 0) * 0.01 AS rint_x FROM lineitem) GROUP BY 1, 2""")
oracle("las_headers", sql="""
  SELECT count(*) AS points, rnd(min(l_quantity), 2) AS min_y, rnd(max(l_quantity), 2) AS max_y, CAST(0 AS BIGINT) AS errors FROM lineitem""")
oracle("stored_points", "numbered_cloud", sql="""
  SELECT point_idx, rnd(CAST(CAST(x AS FLOAT) AS DOUBLE), 2) AS x, rnd(CAST(CAST(y AS FLOAT) AS DOUBLE), 2) AS y,
    rnd(CAST(CAST(z AS FLOAT) AS DOUBLE), 2) AS z FROM numbered_cloud""")
oracle("published_timeline", "fused", sql="""
  SELECT zone, time_step, count(*) AS rows, max(final_segment_risk) AS top_risk
  FROM fused, (VALUES ('ready'), ('served')) z(zone) GROUP BY zone, time_step""")
oracle("served_step", "fused", sql="""
  SELECT asked, time_step, segment_id, final_segment_risk, risk_level FROM fused, (VALUES ('7'), ('100000'), ('all')) a(asked)
  WHERE CASE asked WHEN '7' THEN time_step = 7 WHEN 'all' THEN true ELSE time_step = (SELECT min(time_step) FROM fused) END""")
oracle("decimate", "sampled", sql="SELECT worker_id, time_step, pose_x, pose_y FROM sampled")
oracle("point_decimation", "numbered_cloud", sql="SELECT point_idx, x, y, z FROM numbered_cloud WHERE point_idx % 500 = 0")
view("sample_plan", sql="""
  SELECT *, CAST(ceil(take / per) AS BIGINT) AS wins
  FROM (SELECT *, CAST(greatest(1, ceil(take / least(100, take))) AS BIGINT) AS per
        FROM (SELECT count(*) AS total, CAST(count(*) // 4 AS BIGINT) AS take FROM events))""")
view("sample_windows", "sample_plan", sql="""
  SELECT CAST(i AS BIGINT) AS i, per, take,
    CAST(round_even(i * greatest(0, total - per) / greatest(1, wins - 1), 0) AS BIGINT) AS first
  FROM sample_plan, range(100) r(i) WHERE i < wins""")
view("sample", "sample_windows", "numbered_cloud", sql="""
  SELECT i * per + point_idx - first AS sample_idx, point_idx, x, y, z FROM sample_windows JOIN numbered_cloud
  ON point_idx >= first AND point_idx < first + per AND i * per + point_idx - first < take""")
oracle("las_window_sample", "sample", sql="""
  SELECT point_idx, rnd(round_even(x / 0.01, 0) * 0.01, 2) AS x, rnd(round_even(y / 0.01, 0) * 0.01, 2) AS y,
    rnd(round_even(z / 0.01, 0) * 0.01, 2) AS z FROM sample""")
oracle("window_sample", "sample", sql="SELECT sample_idx, point_idx, x FROM sample")
oracle("sample_bounds", "sample", sql="""
  SELECT count(*) AS sampled_point_count, rnd(min(x), 6) AS min_x, rnd(min(y), 6) AS min_y, rnd(min(z), 6) AS min_z,
         rnd(max(x), 6) AS max_x, rnd(max(y), 6) AS max_y, rnd(max(z), 6) AS max_z FROM sample""")
oracle("point_limit", "numbered_cloud", sql="""
  SELECT point_idx, rnd(x, 2) AS x, rnd(y, 2) AS y, rnd(z, 2) AS z FROM numbered_cloud WHERE point_idx < 5000""")
oracle("point_bounds", "cloud", sql="""
  SELECT rnd(min(x), 6) AS min_x, rnd(min(y), 6) AS min_y, rnd(min(z), 6) AS min_z,
         rnd(max(x), 6) AS max_x, rnd(max(y), 6) AS max_y, rnd(max(z), 6) AS max_z FROM cloud""")
SLICE_COLUMNS = (
    "bbox_width_x", "bbox_width_y", "bbox_height_z", "centroid_x", "centroid_y", "centroid_z", "width_proxy",
    "height_proxy", "ceiling_z_p95", "floor_z_p05", "ceiling_roughness",
)
oracle("slice_features", "slices", sql=f"""
  SELECT slice_index, point_count, {', '.join(f'rnd({c}, 6) AS {c}' for c in SLICE_COLUMNS)} FROM slices""")
oracle("geometry_risk", "geometry", sql=f"""
  SELECT segment_id, slice_index, rnd(narrowness_score, 3) AS narrowness_score, rnd(low_ceiling_score, 3) AS low_ceiling_score,
    rnd(ceiling_roughness_score, 3) AS ceiling_roughness_score, rnd(geometry_change_score, 3) AS geometry_change_score,
    rnd(risk, 3) AS lidar_geometry_risk, {level('risk')} AS risk_level FROM geometry""")
oracle("segment_positions", "geometry", sql="""
  SELECT segment_id, rnd(arg_max(centroid_x, slice_index), 2) AS x, rnd(arg_max(centroid_y, slice_index), 2) AS y,
    rnd(arg_max(centroid_z, slice_index), 2) AS z FROM geometry GROUP BY segment_id""")
oracle("point_density", "slices", sql="""
  SELECT slice_index, point_count, rnd(CASE WHEN bbox_width_x * bbox_width_y * bbox_height_z > 0
    THEN point_count / (bbox_width_x * bbox_width_y * bbox_height_z) ELSE 0.0 END, 6) AS point_density FROM slices""")
oracle("worker_timeline", "workers", sql="SELECT * FROM workers")
oracle("gas_row_mean", "methane", sql="SELECT row_idx, rnd(methane, 6) AS methane FROM methane")
oracle("gas_normaliser", "gas_norm", sql="""
  SELECT rnd(p99, 6) AS p99, rnd(max_value, 6) AS max_value, rnd(normaliser, 6) AS normaliser FROM gas_norm""")
oracle("gas_timeline", "gas", sql="SELECT * FROM gas")
oracle("drift_batches", "batch_stats", "drift_parsed", sql="""
  SELECT file_name, rows_scanned, counts AS class_counts, rnd(mean, 3) AS concentration_mean, rnd(dev, 3) AS concentration_stdev
  FROM batch_stats JOIN (SELECT file_name, string_agg(class || ':' || CAST(n AS VARCHAR), ',' ORDER BY class) AS counts
    FROM (SELECT file_name, class, count(*) AS n FROM drift_parsed GROUP BY file_name, class) GROUP BY file_name) USING (file_name)""")
oracle("reliability", "reliability", sql="SELECT * FROM reliability")
oracle("adjacency", "arcs", sql="SELECT src, dst, segment_id, length FROM arcs WHERE segment_id <> 'SEG_003'")
oracle("reachable", "open_reach", sql="SELECT node FROM open_reach")
oracle("unreached", "open_reach", "node_set", sql="SELECT node_id FROM node_set WHERE node_id NOT IN (SELECT node FROM open_reach)")
oracle("edge_impact", "impact", sql="SELECT segment_id, disconnected_node_count, total_node_count FROM impact")
oracle("graph_risk", "graph_risk", sql=f"""
  SELECT segment_id, from_node, to_node, length, is_chokepoint, disconnected_node_count, total_node_count,
    rnd(blocking, 3) AS graph_blocking_score, rnd(choke, 3) AS chokepoint_score, rnd(len_score, 3) AS length_score,
    rnd(score, 3) AS graph_risk_score, {level('score')} AS risk_level FROM graph_risk""")
oracle("hop_route", "node_set", "hop_routes", sql="""
  SELECT node_id AS start_node, 'SEG_003' AS blocked_segment, route AS route_nodes FROM node_set LEFT JOIN hop_routes ON start = node_id""")
oracle("weighted_route", "one_parents", sql="""
  SELECT time_step, node, rnd(cost, 3) AS cost, hops, up.n AS parent, 'SEG_' || substr(up.g, 2) AS parent_segment FROM one_parents""")
oracle("route_requests", "asks", sql="SELECT request_id, worker_id, time_step, start_segment, blocked_segment FROM asks")
oracle("emergency_route", "answers", sql="SELECT * FROM answers")
oracle("critical_scenario", "hot_scenario", sql="SELECT * EXCLUDE (event_level) FROM hot_scenario")
oracle("emergency_scenario", "scenario", sql="SELECT * EXCLUDE (event_level) FROM scenario")
oracle("graph_nodes", "node_set", sql="SELECT node_id, node_id = '0' AS is_exit FROM node_set")
oracle("graph_edges", "segments", sql=f"SELECT {short('segment_id')} AS segment_id, from_node, to_node, length, is_chokepoint FROM segments")
oracle("fused_timeline", "fused", sql="SELECT * EXCLUDE (seg_no) FROM fused")
oracle("fusion_alternative", "grid", sql=f"""
  SELECT time_step, segment_id, rnd(f, 3) AS final_segment_risk, {level('f')} AS risk_level
  FROM (SELECT *, 0.30 * adjusted + 0.25 * shape + 0.25 * exposure + 0.20 * graph AS f FROM grid)""")
oracle("top_risks", "fused", sql="""
  SELECT time_step, segment_id, final_segment_risk FROM fused ORDER BY final_segment_risk DESC, time_step, seg_no LIMIT 10""")
oracle("topk_per_step", "fused", sql="""
  SELECT time_step, rank, segment_id, final_segment_risk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY time_step
    ORDER BY final_segment_risk DESC, seg_no) AS INTEGER) AS rank FROM fused) WHERE rank <= 15""")
oracle("gas_first_k", "gas", sql="""
  SELECT time_step, rank, sensor_id, segment_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY time_step
    ORDER BY sensor_id, segment_id) AS INTEGER) AS rank FROM gas) WHERE rank <= 8""")
oracle("event", "event", sql="SELECT * FROM event")
oracle("workers_at_event", "workers", sql=last_known("33"))
oracle("worker_playback", "playback", sql="SELECT * FROM playback")
oracle("worker_trail", "playback", sql="""
  SELECT worker_id, time_step, string_agg(mapped_segment_id, '>') OVER (PARTITION BY worker_id ORDER BY time_step
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trail FROM playback""")
oracle("playback_panel", "playback", "scenario", "fused", sql="""
  SELECT p.time_step, p.worker_id, p.mapped_segment_id AS worker_segment, p.motion_status, t.segment_id AS top_segment,
    t.final_segment_risk AS top_risk, t.risk_level AS top_level,
    CASE WHEN p.time_step >= s.time_step THEN s.blocked_segment END AS blocked_segment,
    CASE WHEN p.time_step >= s.time_step THEN s.exit_reachable_after_blockage END AS exit_reachable,
    p.scenario_code, s.alternative_route_to_exit
  FROM playback p JOIN scenario s USING (worker_id)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time_step ORDER BY final_segment_risk DESC, seg_no) AS r
             FROM fused) WHERE r = 1) t ON t.time_step = p.time_step""")
oracle("view_segments", "segments", sql=f"""
  SELECT seg_no, {short('segment_id')} AS segment_id, from_node, to_node, length, notes, is_chokepoint, false AS is_blocked, 'sample' AS source
  FROM segments""")
oracle("view_workers", "workers", sql=f"""
  SELECT time_step, worker_id, {short('mapped_segment_id')} AS current_segment, {short('mapped_segment_id')} AS mapped_segment_id,
    CASE motion_status WHEN 'fast_motion' THEN 0.78 WHEN 'stationary' THEN 0.92 ELSE 0.86 END::DOUBLE AS position_reliability,
    'safe' AS status, pose_x AS position_x FROM workers WHERE time_step = 6""")
oracle("view_risks", "fused", sql=f"""
  SELECT time_step, {short('segment_id')} AS segment_id, lower(risk_level) AS risk_level, final_segment_risk AS final_risk_score,
    lidar_geometry_risk AS geometry_risk, methane_risk_score AS environmental_risk, worker_exposure_score AS worker_exposure_risk,
    graph_risk_score AS route_blockage_risk, concat_ws('; ', lidar_reason, graph_reason, gas_reason, worker_reason) AS reasons FROM fused WHERE time_step = 6""")
oracle("view_gas", "gas", sql=f"SELECT * REPLACE ({short('segment_id')} AS segment_id) FROM gas WHERE time_step = 6")
oracle("view_collapse", "scenario", sql=f"""
  SELECT worker_id, {short('worker_segment')} AS worker_segment, {short('blocked_segment')} AS blocked_segment,
    {short('blocked_segment')} AS event_segment, lower(event_level) AS event_level FROM scenario""")
oracle("risk_by_segment", "fused", sql=f"""
  SELECT {short('segment_id')} AS segment_id, arg_max(final_segment_risk, time_step) AS final_risk_score, max(time_step) AS time_step
  FROM fused GROUP BY segment_id""")
oracle("gas_threshold", "gas", sql="SELECT time_step, sensor_id, methane_value, methane_value >= 40.0 AS above_threshold FROM gas")
oracle("zscore", sql="""
  SELECT event_id, event_type, rnd(value, 6) AS value, rnd(CASE WHEN dev > 0 THEN (value - mean) / dev ELSE 0.0 END, 6) AS zscore
  FROM events JOIN (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS dev FROM events GROUP BY event_type) USING (event_type)""")
oracle("rolling_mean", "tracks", sql="""
  SELECT worker_id, row_idx, pose_x AS value, rnd(avg(pose_x) OVER w, 6) AS rolling_mean,
    pose_x - first_value(pose_x) OVER w AS rolling_change
  FROM tracks WINDOW w AS (PARTITION BY worker_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
oracle("anomaly_score", "gas", sql="""
  SELECT time_step, sensor_id, rnd(z, 6) AS zscore, round(m, 9) AS rolling_mean, rnd(c, 6) AS rolling_change,
    rnd(least(1.0, greatest(0.0, 0.4 * (CASE WHEN methane_value >= 40.0 THEN 1.0 ELSE 0.0 END) + 0.3 * least(1.0, abs(z) / 3.0)
      + 0.3 * least(1.0, abs(c) / 50.0))), 6) AS anomaly_score
  FROM (SELECT time_step, sensor_id, methane_value, avg(methane_value) OVER w AS m, methane_value - first_value(methane_value) OVER w AS c,
          (methane_value - avg(methane_value) OVER (PARTITION BY sensor_id)) / stddev_samp(methane_value) OVER (PARTITION BY sensor_id) AS z
        FROM gas WINDOW w AS (PARTITION BY sensor_id ORDER BY time_step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""")
oracle("nearest_segment", "numbered_cloud", "geometry", "segments", sql="""
  SELECT point_idx AS pos_id, b.s AS segment_id, rnd(b.d, 6) AS distance
  FROM (SELECT point_idx, min({'d': sqrt((x - centroid_x) ** 2 + (y - centroid_y) ** 2 + (z - centroid_z) ** 2), 'n': s.seg_no, 's': g.segment_id}) AS b
        FROM numbered_cloud CROSS JOIN geometry g JOIN segments s ON s.segment_id = g.segment_id GROUP BY point_idx)""")
oracle("stillness", "workers", sql="""
  SELECT worker_id, min(time_step) AS from_step, max(time_step) AS to_step, count(*) AS steps
  FROM (SELECT *, time_step - row_number() OVER (PARTITION BY worker_id ORDER BY time_step) AS run FROM workers WHERE motion_status = 'still')
  GROUP BY worker_id, run""")
oracle("risk_trend", "fused", sql="""
  SELECT segment_id, rnd(coalesce(regr_slope(final_segment_risk, time_step), 0.0), 6) AS risk_slope, count(*) AS steps FROM fused GROUP BY segment_id""")
oracle("worker_status", "answers", "asks", sql="""
  SELECT worker_id, time_step, start_segment AS current_segment, CASE WHEN trapped THEN 'trapped' ELSE 'safe' END AS status FROM answers""")
