import heapq
import random

import pytest
from pyspark.sql import functions as F

from adit import workspace
from adit.operators import graph, overlay, routing, segments
from adit.operators.segments import nodes
from adit.workspace import one_row


def edge_impact_by_search(segments, exit_node):
    """The same counts by one search per segment; the check for small graphs."""
    roots = segments.select(
        F.col("seg_no").alias("scenario"),
        F.lit(exit_node).alias("root"),
        F.col("segment_id").alias("blocked_segment"),
    )
    tree, _ = graph.hop_tree(segments, roots)
    known = tree.join(nodes(segments), F.col("node") == F.col("node_id"), "left_semi")
    reached = known.groupBy(F.col("scenario").alias("seg_no")).agg(F.count(F.lit(1)).alias("_n"))
    total = one_row(nodes(segments), F.count(F.lit(1)).alias("n"))["n"]
    return segments.join(reached, "seg_no", "left").select(
        "segment_id", (total - F.coalesce("_n", F.lit(0))).cast("bigint").alias("disconnected_node_count")
    )


def build(spark, edges):
    """edges: (from, to, length, notes)."""
    rows = [(i, a, b, None if n is None else str(n), t) for i, (a, b, n, t) in enumerate(edges)]
    schema = "row_no bigint, FROM string, TO string, LENGTH string, NOTES string"
    return segments.build_segments(spark.createDataFrame(rows, schema))


LADDER = [
    ("3", "1", 5.0, ""),
    ("1", "2", 4.0, "a Chokepoint here"),
    ("2", "4", None, ""),
    ("1", "4", 0.0, ""),
    ("4", "5", 2.0, ""),
    ("5", "5", 1.0, ""),
    ("5", "6", 1.0, ""),
    ("5", "6", 9.0, ""),
    ("8", "9", 3.0, ""),
]


def reach(edges, start, blocked=None):
    seen, todo = {start}, [start]
    while todo:
        n = todo.pop()
        for i, (a, b, *_) in enumerate(edges):
            if i != blocked:
                for p, q in ((a, b), (b, a)):
                    if p == n and q not in seen:
                        seen.add(q)
                        todo.append(q)
    return seen


def test_segments_degree_and_anchors(spark):
    s = build(spark, LADDER)
    first, second, third = s.orderBy("seg_no").take(3)
    assert (first.segment_id, first.is_chokepoint) == ("SEG_001", False)
    assert second.is_chokepoint and third.length == 0.0
    assert {r.node_id: r.degree for r in segments.node_degree(s).collect()}["5"] == 5
    anchors = sorted(tuple(r) for r in segments.place_anchors(s, "3").collect())
    assert anchors == [
        ("ANCHOR_01", "1", None, "junction"),
        ("ANCHOR_02", "3", None, "exit_node"),
        ("ANCHOR_03", "4", None, "junction"),
        ("ANCHOR_04", "5", None, "junction"),
        ("ANCHOR_05", "1", "SEG_002", "chokepoint_segment"),
    ]


def test_sensor_placement_falls_back_to_the_longest(spark):
    s = build(spark, LADDER)
    assert [tuple(r)[:2] for r in segments.place_sensors(s).collect()] == [("GAS_SENSOR_01", "SEG_002")]
    plain = build(spark, [(a, b, n, "") for a, b, n, _ in LADDER])
    assert [r.segment_id for r in segments.place_sensors(plain).collect()] == ["SEG_008", "SEG_001", "SEG_002"]


def test_reachable_and_unreached(spark):
    s = build(spark, LADDER)
    got = graph.reachable_nodes(s, "3", "SEG_005")
    assert {r.node for r in got.collect()} == {"3", "1", "2", "4"}
    assert {r.node_id for r in graph.unreached_nodes(s, got).collect()} == {"5", "6", "8", "9"}
    assert {r.node for r in graph.reachable_nodes(s, "elsewhere").collect()} == {"elsewhere"}


def random_edges(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 14)
    count = rng.randrange(1, 20)
    return [(str(rng.randrange(n)), str(rng.randrange(n)), float(rng.randrange(1, 9)), "") for _ in range(count)]


@pytest.mark.parametrize("edges", [LADDER, *[random_edges(s) for s in range(4)]], ids=str)
def test_edge_impact_equals_one_search_per_segment(spark, edges):
    s = build(spark, edges)
    exit_node = edges[0][0]
    nodes = {x for a, b, *_ in edges for x in (a, b)}
    got = {r.seg_no: (r.disconnected_node_count, r.total_node_count) for r in graph.edge_impact(s, exit_node).collect()}
    assert got == {i + 1: (len(nodes - reach(edges, exit_node, i)), len(nodes)) for i in range(len(edges))}


RINGS = [("3", "a", 1.0, ""), ("a", "b", 1.0, ""), ("b", "c", 1.0, ""), ("c", "a", 1.0, ""), ("b", "d", 1.0, ""),
         ("d", "e", 1.0, ""), ("e", "b", 1.0, ""), ("e", "f", 1.0, ""), ("f", "g", 1.0, ""), ("3", "h", 1.0, ""), ("h", "3", 1.0, ""),
         ("x", "y", 1.0, ""), ("y", "z", 1.0, ""), ("z", "x", 1.0, ""), ("p", "q", 1.0, ""), ("q", "p", 1.0, ""), ("g", "g", 1.0, "")]
PASSAGE = [(str(i), str(i + 1), 1.0, "") for i in range(70)] + [("20", "b0", 1.0, "")] + [
    (f"b{i}", f"b{i + 1}", 1.0, "") for i in range(30)
] + [("b30", "40", 1.0, "")]
LINE = [(str(i), str(i + 1), 1.0, "") for i in range(100)]


@pytest.mark.parametrize(("edges", "exit_node"), [(RINGS, "3"), (RINGS, "x"), (PASSAGE, "55"), (LINE, "0")])
def test_edge_impact_on_rings_and_long_passages(spark, edges, exit_node):
    nodes = {x for a, b, *_ in edges for x in (a, b)}
    s = build(spark, edges)
    got = {r.seg_no: r.disconnected_node_count for r in graph.edge_impact(s, exit_node).collect()}
    assert got == {i + 1: len(nodes - reach(edges, exit_node, i)) for i in range(len(edges))}
    seen = {r.node for r in graph.reachable_nodes(s, exit_node, "SEG_003").collect()}
    assert seen == reach(edges, exit_node, 2)


def test_edge_impact_with_an_exit_outside_the_graph(spark):
    s = build(spark, LADDER)
    assert {r.disconnected_node_count for r in graph.edge_impact(s, "nowhere").collect()} == {8}
    by_search = {r.segment_id: r.disconnected_node_count for r in edge_impact_by_search(s, "3").collect()}
    fast = {r.segment_id: r.disconnected_node_count for r in graph.edge_impact(s, "3").collect()}
    assert fast == by_search


def test_graph_risk_with_equal_lengths(spark):
    s = build(spark, [("3", "1", 2.0, "chokepoint"), ("1", "2", 2.0, "")])
    rows = {r.segment_id: r for r in graph.graph_risk(s, graph.edge_impact(s, "3")).collect()}
    assert rows["SEG_001"].length_score == 0.0
    # 2 of 3 nodes are cut off: .6 * 66.667 + .25 * 100
    assert rows["SEG_001"].graph_risk_score == 65.0 and rows["SEG_001"].risk_level == "HIGH"
    assert rows["SEG_002"].graph_risk_score == 20.0


def test_hop_routes(spark):
    s = build(spark, LADDER)
    asks = spark.createDataFrame(
        [("a", "6", None), ("b", "6", "SEG_004"), ("c", "3", "SEG_001"), ("d", "6", "SEG_001"), ("e", "9", None), ("f", "zz", None)],
        "request_id string, start_node string, blocked_segment string",
    )
    got = {r.request_id: r.route_nodes for r in routing.hop_routes(s, asks, "3").collect()}
    assert got == {
        "a": ["6", "5", "4", "1", "3"], "b": ["6", "5", "4", "2", "1", "3"], "c": ["3"], "d": None, "e": None, "f": None,
    }


def cheapest(edges, weight, start, goal, blocked):
    """Cost by search from the start, None without a way."""
    heap, done = [(0.0, start)], set()
    while heap:
        cost, node = heapq.heappop(heap)
        if node == goal:
            return cost
        if node in done:
            continue
        done.add(node)
        for i, (a, b, *_) in enumerate(edges):
            if i != blocked:
                for p, q in ((a, b), (b, a)):
                    if p == node:
                        heapq.heappush(heap, (cost + weight(i), q))
    return None


@pytest.mark.parametrize("seed", range(3))
def test_emergency_routes_are_cheapest_under_every_blockage(spark, seed):
    edges = LADDER if seed == 0 else random_edges(100 + seed)
    goal = "3" if seed == 0 else edges[0][0]
    rng = random.Random(seed)
    risk = {(t, i): float(rng.randrange(0, 100)) for t in (2, 5) for i in range(len(edges)) if rng.random() < 0.8}
    risk[(2, 0)], risk[(5, 0)] = 1.0, 2.0
    risks = spark.createDataFrame(
        [(t, f"SEG_{i + 1:03d}", r) for (t, i), r in risk.items()], "time_step int, segment_id string, final_risk_score double"
    )
    asks = [(t, i, b) for t in (2, 5, 9) for i in range(len(edges)) for b in (None, *range(len(edges)))]
    name = lambda i: None if i is None else f"SEG_{i + 1:03d}"
    requests = spark.createDataFrame(
        [(n, t, name(i), name(b)) for n, (t, i, b) in enumerate(asks)],
        "request_id int, time_step int, start_segment string, blocked_segment string",
    )
    got = {r.request_id: r for r in routing.emergency_routes(build(spark, edges), requests, goal, risks).collect()}
    assert len(got) == len(asks)
    for n, (t, i, b) in enumerate(asks):
        row, step = got[n], 2 if t == 9 else t

        def weight(k):
            return (edges[k][2] or 1.0) + risk.get((step, k), 0.0) * 0.20

        if b == i:
            assert (row.reason, row.reachable, row.route_nodes) == ("worker_segment_blocked", False, [])
            continue
        costs = [cheapest(edges, weight, end, goal, b) for end in edges[i][:2]]
        costs = [c for c in costs if c is not None]
        if not costs:
            assert row.reason == "no_route_to_exit" and row.trapped and row.route_segments == []
            continue
        assert row.reason == "route_found" and row.reachable
        assert abs(row.total_cost - min(costs)) < 2e-3
        steps = [int(x[4:]) - 1 for x in row.route_segments]
        assert b not in steps and row.route_nodes[-1] == goal and row.route_nodes[0] in edges[i][:2]
        for k, (p, q) in zip(steps, zip(row.route_nodes, row.route_nodes[1:])):
            assert {p, q} == set(edges[k][:2])


def test_requests_at_one_place_share_a_route(spark, monkeypatch):
    written = {}

    def counted(df, name, inside=None, f=overlay.materialize):
        written[name] = f(df, name, inside)
        return written[name]

    monkeypatch.setattr(overlay, "materialize", counted)
    blocks = [None, "SEG_001", "SEG_002", "SEG_003"]
    rows = [(n, 1, "SEG_007", blocks[n % 4]) for n in range(200)]
    requests = spark.createDataFrame(rows, "request_id int, time_step int, start_segment string, blocked_segment string")
    got = {r.request_id: r for r in routing.emergency_routes(build(spark, LADDER), requests, "3").collect()}
    # Two ends of one segment; each blockage may add a way around it.
    assert len(got) == 200 and written["routes"].count() <= 2 * len(blocks)
    for n, r in got.items():
        first = got[n % 4]
        assert (r.reason, r.route_nodes, r.route_segments, r.total_cost) == (first.reason, first.route_nodes, first.route_segments, first.total_cost)


def test_worker_status_reads_no_routes(spark):
    s = segments.segment_view(build(spark, LADDER))
    workers = spark.createDataFrame([("w1", 1, "S007", "ok"), ("w2", 1, "S003", "ok")], "worker_id string, time_step int, current_segment string, status string")
    asks = spark.createDataFrame([("a", "w1", 1, None, "S001"), ("b", "w2", 1, None, None)], "request_id string, worker_id string, time_step int, segment_id string, blocked_segment string")
    resolved = routing.resolve_requests(asks, workers, spark.createDataFrame([("S005",)], "blocked_segment string"))
    answers = routing.answer_requests(s, resolved, "3")
    status = routing.worker_status(workers, answers)
    trapped = {r.worker_id: r.trapped for r in answers.collect()}
    assert {r.worker_id: r.status for r in status.collect()} == {w: "trapped" if t else "safe" for w, t in trapped.items()}
    read = [line for line in status._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    assert read and not any("route_nodes" in line or "route_segments" in line for line in read)


def test_route_requests_fall_back(spark):
    s = segments.segment_view(build(spark, LADDER))
    workers = spark.createDataFrame(
        [("w1", 1, "S007"), ("w1", 2, "S001"), ("w2", 2, "S003")], "worker_id string, time_step int, current_segment string"
    )
    collapse = spark.createDataFrame([("S005",)], "blocked_segment string")
    asks = spark.createDataFrame(
        [
            ("a", "w1", 2, None, None),
            ("b", "w1", 77, None, "S002"),
            ("c", "nobody", 1, None, None),
            ("d", "w1", 1, "S003", None),
            ("e", "w2", 1, None, None),
            ("f", "w1", 1, "S999", None),
        ],
        "request_id string, worker_id string, time_step int, segment_id string, blocked_segment string",
    )
    resolved = routing.resolve_requests(asks, workers, collapse)
    got = {r.request_id: r for r in routing.answer_requests(s, resolved, "3").collect()}
    assert got["a"].start_segment == "S001" and got["a"].total_cost == 0.0 and got["a"].route_nodes == ["3"]
    assert got["b"].start_segment == "S007" and got["b"].blocked_segment == "S002" and got["b"].reason == "route_found"
    assert got["c"].reason == "worker_not_found" and got["e"].reason == "worker_not_found"
    assert got["d"].reason == "route_found" and got["d"].blocked_segment == "S005"
    assert (got["f"].reason, got["f"].exit_node, got["f"].route_nodes) == ("start_segment_not_found", None, None)
    status = routing.worker_status(workers.withColumn("status", F.lit("safe")), got_frame(spark, [("w1", 2, True)]))
    assert {(r.worker_id, r.time_step): r.status for r in status.collect()}[("w1", 2)] == "trapped"


def got_frame(spark, rows):
    return spark.createDataFrame(rows, "worker_id string, time_step int, trapped boolean")


def test_negative_weights_are_refused(spark):
    s = build(spark, [("3", "1", 5, ""), ("1", "2", -7, "")])
    asks = spark.createDataFrame([("q", 0, s.first().segment_id, None)], "request_id string, time_step int, start_segment string, blocked_segment string")
    with pytest.raises(Exception, match="negative weight of segment"):
        routing.emergency_routes(s, asks, "3").collect()


def counted_tables(monkeypatch):
    """Names of the tables that loops write from here on."""
    written = []
    plain = workspace.materialize_measured

    def spy(df, name, *args, **kw):
        written.append(name)
        return plain(df, name, *args, **kw)

    monkeypatch.setattr(workspace, "materialize_measured", spy)
    monkeypatch.setattr(graph, "materialize_measured", spy)
    return written


def test_routes_along_a_chain_take_few_rounds(spark, monkeypatch):
    """10,000 segments in a row, with a loop at the far end that a blockage can be passed by."""
    n = 10_000
    ids = spark.range(n).select(F.col("id").alias("row_no"), F.col("id").cast("string").alias("FROM"), (F.col("id") + 1).cast("string").alias("TO"))
    back = spark.createDataFrame([(n, str(n), str(n - 50)), (n + 1, "x", "y")], ids.schema)
    rows = ids.unionByName(back).withColumn("LENGTH", F.lit("1")).withColumn("NOTES", F.lit(""))
    s = segments.build_segments(rows).cache()
    asks = spark.createDataFrame(
        [("far", str(n), None), ("cut", str(n), f"SEG_{n:03d}"), ("lost", "7000", "SEG_005"), ("mid", "7000", "SEG_8000"), ("off", "x", None)],
        "request_id string, start_node string, blocked_segment string",
    )
    written = counted_tables(monkeypatch)
    got = {r.request_id: r.route_nodes for r in routing.hop_routes(s, asks, "0").collect()}
    assert got["far"] == [str(n), *map(str, range(n - 50, -1, -1))] and got["mid"] == list(map(str, range(7000, -1, -1)))
    assert got["cut"] == got["far"] and got["lost"] is None and got["off"] is None
    assert len(written) <= 30, written


@pytest.mark.parametrize("seed", range(2))
def test_routes_of_all_nodes_match_a_plain_search(spark, seed):
    """Cost, length and ties of every node, on graphs with long passages, rings and parallel ways."""
    rng = random.Random(seed)
    edges, node = [("j0", "j1", 1.0, "")], 0
    for _ in range(14):
        a, b = f"j{rng.randrange(6)}", f"j{rng.randrange(6)}"
        path = [a, *[f"n{node + i}" for i in range(rng.randrange(0, 6))], b]
        node += len(path)
        edges += [(p, q, rng.choice([0.25, 1.0, 1.0, 2.5]), "") for p, q in zip(path, path[1:])]
    edges += [("r1", "r2", 1.0, ""), ("r2", "r3", 1.0, ""), ("r3", "r1", 1.0, "")]
    s = build(spark, edges)
    weights = s.select(F.lit(0).alias("time_step"), "seg_no", F.col("length").alias("weight"))
    starts = nodes(s).select(F.col("node_id").alias("start_id"), F.lit(0).alias("time_step"), F.lit("").alias("blocked_segment"), F.col("node_id").alias("node"))
    got = {r.start_id: r for r in overlay.best_routes(s, weights, "j0", starts).collect()}
    near = lambda at: [(q, w) for x, y, w, _ in edges for p, q in ((x, y), (y, x)) if p == at]
    want, heap = {}, [(0.0, 0, "j0")]
    while heap:
        c, h, at = heapq.heappop(heap)
        if at not in want:
            want[at] = (c, h)
            for q, w in near(at):
                heapq.heappush(heap, (c + w, h + 1, q))
    assert {k: (sum(r.weights), len(r.route_segments)) for k, r in got.items()} == want
    for k, r in got.items():
        assert r.route_nodes[0] == k and r.route_nodes[-1] == "j0" and len(r.route_nodes) == len(r.route_segments) + 1
        if k != "j0":
            # Of all equally good next nodes the smallest.
            assert r.route_nodes[1] == min(q for q, w in near(k) if want.get(q) == (want[k][0] - w, want[k][1] - 1))
