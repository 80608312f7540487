"""Lowest-cost escape routes for many workers, steps and blockages at once.

One tree per time step is grown from the exit and serves every worker of the
step; a blockage moves only what hangs on the blocked passage. The search
itself is in :mod:`adit.operators.overlay`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.functions.scores import edge_weight, exact_round
from adit.operators import overlay
from adit.operators.graph import both_ways
from adit.workspace import loop_folder, materialize, materialize_counted, one_row, task_count

ROUNDS_PER_MERGE = 8
# Fixed value: name of the cost rule.
COST_POLICY = "length + final_risk_score * 0.20"


def risk_edges(segments: DataFrame, risks: DataFrame | None, steps: DataFrame) -> DataFrame:
    """Weighted adjacency per time step: (time_step, way, src, dst, seg_no, segment_id, weight).

    ``risks``: (time_step, segment_id, final_risk_score). ``steps`` has the
    distinct requested steps; a step without risk rows weighs lengths only.
    """
    wanted = one_row(steps, F.sort_array(F.collect_set("time_step")).alias("a"))["a"]
    tasks = task_count(segments.sparkSession)
    dense = segments.repartition(tasks, "segment_id").withColumn("time_step", F.explode(wanted))
    if risks is None:
        dense = dense.withColumn("_risk", F.lit(0.0))
    else:
        known = risks.join(steps, "time_step", "left_semi").select(
            "time_step", "segment_id", F.col("final_risk_score").alias("_risk")
        )
        dense = dense.join(known, ["time_step", "segment_id"], "left")
    weight = edge_weight(F.col("length"), F.col("_risk"))
    # A way that gains by going back and forth has no cheapest route.
    refused = F.raise_error(F.concat(F.lit("negative weight of segment "), F.col("segment_id"))).cast("double")
    weight = F.when(weight < 0, refused).otherwise(weight)
    return dense.select("time_step", "seg_no", "segment_id", weight.alias("weight"), both_ways().alias("_e")).select(
        "time_step", "_e.way", "_e.src", "_e.dst", "seg_no", "segment_id", "weight"
    )


def settle(state: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Relax costs along ``links`` until no node improves.

    ``state``: keys, node, cost, hops of the nodes known so far. ``links``:
    keys, node, dst, weight; a node takes over its neighbour ``dst``.
    """
    best = F.struct("cost", "hops").alias("_b")
    with loop_folder(links.sparkSession, "settling") as folder:
        frontier = materialize(state.select(*keys, "node", best), "costs", inside=folder)
        known, improved = [frontier], 1
        while improved:
            reached = (
                frontier.withColumnRenamed("node", "dst")
                .join(links.select(*keys, "node", "dst", "weight"), [*keys, "dst"])
                .groupBy(*keys, "node")
                .agg(F.min(F.struct((F.col("_b.cost") + F.col("weight")).alias("cost"), (F.col("_b.hops") + 1).alias("hops"))).alias("_b"))
            )
            # Only what got better is written; the rounds before are merged now and then.
            so_far = reduce(DataFrame.unionByName, known).groupBy(*keys, "node").agg(F.min("_b").alias("_old"))
            better = reached.join(so_far, [*keys, "node"], "left").where(F.col("_old").isNull() | (F.col("_b") < F.col("_old"))).drop("_old")
            frontier, improved = materialize_counted(better, "costs", inside=folder)
            known.append(frontier)
            if len(known) > ROUNDS_PER_MERGE:
                merged = reduce(DataFrame.unionByName, known).groupBy(*keys, "node").agg(F.min("_b").alias("_b"))
                known = [materialize(merged, "costs", inside=folder)]
        settled = reduce(DataFrame.unionByName, known).groupBy(*keys, "node").agg(F.min("_b").alias("_b"))
        return materialize(settled.select(*keys, "node", "_b.cost", "_b.hops"), "settled")


def with_parents(costs: DataFrame, links: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
    """The tree behind settled costs.

    ``ahead`` has the costs of everything a link can lead to. Of the next
    nodes that explain a cost the smallest is taken, then the lowest segment
    number.
    """
    toward = ahead.select(*keys, F.col("node").alias("dst"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    parents = (
        costs.join(links, [*keys, "node"])
        .join(toward, [*keys, "dst"])
        .where((F.col("cost") == F.col("_c") + F.col("weight")) & (F.col("hops") == F.col("_h") + 1))
        .groupBy(*keys, "node")
        .agg(F.min(F.struct("dst", "seg_no", "segment_id", "weight")).alias("_p"))
    )
    return costs.join(parents, [*keys, "node"], "left").select(
        *keys,
        "node",
        "cost",
        "hops",
        F.col("_p.dst").alias("parent"),
        F.col("_p.segment_id").alias("parent_segment"),
        F.col("_p.weight").alias("parent_weight"),
    )


def cost_trees(edges: DataFrame, exit_node: str) -> DataFrame:
    """Shortest-path tree from the exit per time step of ``edges``.

    Returns (time_step, node, cost, hops, parent, parent_segment,
    parent_weight).
    """
    links = edges.where(F.col("src") != F.col("dst")).withColumnRenamed("src", "node")
    exits = edges.select("time_step").distinct().select(
        "time_step", F.lit(exit_node).alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")
    )
    costs = settle(exits, links, ["time_step"])
    return materialize(with_parents(costs, links, costs, ["time_step"]), "tree")


def segment_weights(edges: DataFrame) -> DataFrame:
    """One row per step and segment of the weighted adjacency."""
    return edges.where("way = 0").select("time_step", "seg_no", "weight")


def hop_routes(segments: DataFrame, requests: DataFrame, exit_node: str) -> DataFrame:
    """Fewest-segment route to the exit per request.

    ``requests``: (request_id, start_node, blocked_segment). All columns are
    kept; ``route_nodes`` is null where the exit cannot be reached.
    """
    weights = segments.select(F.lit(0).alias("time_step"), "seg_no", F.lit(1.0).alias("weight"))
    starts = requests.select(
        F.col("request_id").alias("start_id"),
        F.lit(0).alias("time_step"),
        F.coalesce("blocked_segment", F.lit(overlay.NO_BLOCK)).alias("blocked_segment"),
        F.col("start_node").alias("node"),
    )
    routes = overlay.best_routes(segments, weights, exit_node, starts).withColumnRenamed("start_id", "request_id")
    return requests.join(routes.drop("weights"), "request_id", "left")


def risk_step(requests: DataFrame, risks: DataFrame | None) -> DataFrame:
    """Add ``_step``, the risk step a request is weighed with.

    A step without risk rows falls back to the smallest one, a null step
    (all steps) to the last. Without risks every request shares one tree.
    """
    if risks is None:
        return requests.withColumn("_step", F.lit(0))
    span = one_row(risks, F.min("time_step").alias("lo"), F.max("time_step").alias("hi"))
    present = risks.select(F.col("time_step").alias("_has")).distinct()
    step = F.when(F.col("time_step").isNull(), span["hi"]).otherwise(F.coalesce("_has", span["lo"], F.lit(0)))
    return (
        requests.join(present, F.col("time_step") == F.col("_has"), "left").withColumn("_step", step).drop("_has")
    )


def emergency_routes(
    segments: DataFrame,
    requests: DataFrame,
    exit_node: str,
    risks: DataFrame | None = None,
) -> DataFrame:
    """One route decision per request.

    ``requests``: request_id, time_step, start_segment, blocked_segment (null
    for none), ids already canonical, as in ``segments`` and ``risks``.
    """
    ends = segments.select(
        F.col("segment_id").alias("start_segment"), "from_node", "to_node", F.lit(True).alias("_known")
    )
    asked = materialize(
        risk_step(requests, risks)
        .withColumn("_block", F.coalesce("blocked_segment", F.lit(overlay.NO_BLOCK)))
        .join(ends, "start_segment", "left"),
        "requests",
    )
    end = F.explode(
        F.array(
            F.struct(F.lit(0).alias("rank"), F.col("from_node").alias("node")),
            F.struct(F.lit(1).alias("rank"), F.col("to_node").alias("node")),
        )
    )
    starts = materialize(
        asked.where(F.col("_known") & (F.col("start_segment") != F.col("_block")))
        .select("request_id", "_step", "_block", end.alias("_e"))
        .select(
            F.struct("request_id", "_e.rank").alias("start_id"),
            F.col("_step").alias("time_step"),
            F.col("_block").alias("blocked_segment"),
            "_e.node",
        ),
        "starts",
    )
    edges = materialize(risk_edges(segments, risks, starts.select("time_step").distinct()), "weighted")
    taken, routes = overlay.shared_routes(segments, segment_weights(edges), exit_node, starts)
    # Added up from the start, the way a traveller would.
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    choice = F.struct("cost", F.col("start_id.rank").alias("rank"), "route")
    chosen = (
        taken.join(routes.select("route", total.alias("cost")), "route")
        .groupBy("start_id.request_id")
        .agg(F.min(choice).alias("_b"))
        .select("request_id", "_b.route", F.col("_b.cost").alias("_cost"))
    )
    found = chosen.join(routes.select("route", "route_nodes", "route_segments"), "route", "left").drop("route")
    # Reasons of an answer.
    outcome = (
        F.when(F.col("_known").isNull(), F.lit("start_segment_not_found"))
        .when(F.col("start_segment") == F.col("_block"), F.lit("worker_segment_blocked"))
        .when(F.col("_cost").isNull(), F.lit("no_route_to_exit"))
        .otherwise(F.lit("route_found"))
    )
    reason = F.col("reason")
    empty = F.array().cast("array<string>")
    known = reason != "start_segment_not_found"
    return (
        asked.join(found, "request_id", "left")
        .withColumn("reason", outcome)
        .select(
            *requests.columns[:1],
            "time_step",
            (reason == "route_found").alias("reachable"),
            (reason != "route_found").alias("trapped"),
            "reason",
            "start_segment",
            F.when(known, F.col("blocked_segment")).alias("blocked_segment"),
            F.when(known, F.lit(exit_node)).alias("exit_node"),
            F.when(known, F.coalesce("route_segments", empty)).alias("route_segments"),
            F.when(known, F.coalesce("route_nodes", empty)).alias("route_nodes"),
            exact_round(F.col("_cost"), 3).alias("total_cost"),
            F.when(reason == "route_found", F.lit(COST_POLICY)).alias("cost_policy"),
        )
    )


def resolve_requests(asks: DataFrame, workers: DataFrame, collapse: DataFrame) -> DataFrame:
    """Fill in start and blocked segments.

    ``asks``: request_id, worker_id, time_step, segment_id, blocked_segment,
    the last two may be null. The start defaults to the worker's segment at
    that step, with the smallest step standing in for one that never occurs;
    the blockage to the collapse result's. ``start_segment`` stays null for
    an unknown worker.
    """
    steps = workers.select(F.col("time_step").alias("_t")).distinct()
    first = one_row(workers, F.min("time_step").alias("t"))["t"]
    effective = asks.join(steps, F.col("time_step") == F.col("_t"), "left").withColumn(
        "_t", F.coalesce("_t", first)
    )
    places = workers.groupBy(F.col("worker_id").alias("_w"), F.col("time_step").alias("_s")).agg(
        F.first("current_segment").alias("_here")
    )
    default_block = collapse.select("blocked_segment").scalar()
    return effective.join(
        places, (F.col("worker_id") == F.col("_w")) & (F.col("_t") == F.col("_s")), "left"
    ).select(
        "request_id",
        "worker_id",
        "time_step",
        F.coalesce("segment_id", "_here").alias("start_segment"),
        F.coalesce("blocked_segment", default_block).alias("blocked_segment"),
    )


def answer_requests(
    segments: DataFrame, resolved: DataFrame, exit_node: str, risks: DataFrame | None = None
) -> DataFrame:
    """Routes for resolved requests; unknown workers get ``worker_not_found``."""
    named = resolved.select("request_id", "worker_id")
    routed = emergency_routes(
        segments,
        resolved.where(F.col("start_segment").isNotNull()).drop("worker_id"),
        exit_node,
        risks,
    )
    missing = resolved.where(F.col("start_segment").isNull()).select(
        "request_id", "time_step", F.lit("worker_not_found").alias("reason")
    )
    both = routed.unionByName(missing, allowMissingColumns=True)
    return named.join(both, "request_id")


def worker_status(workers: DataFrame, answers: DataFrame) -> DataFrame:
    """``trapped`` where the route decision finds the exit out of reach."""
    state = answers.select("worker_id", "time_step", "trapped")
    return (
        workers.drop("status")
        .join(state, ["worker_id", "time_step"], "left")
        .withColumn("status", F.when(F.col("trapped"), F.lit("trapped")).otherwise(F.lit("safe")))
        .drop("trapped")
    )
