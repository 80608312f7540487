"""The riskiest event, what it does to each worker, and its playback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.text import canonical_record, canonical_risk_level, canonical_segment_id
from adit.operators.routing import hop_routes
from adit.operators.steps import max_time_step, over_steps
from adit.workspace import materialize, one_row

TOP_PER_STEP = 15
GAS_PER_STEP = 8


def top_risks(fused: DataFrame, k: int) -> DataFrame:
    """Highest fused risks; ties go to the earlier step, then segment order."""
    return fused.orderBy(F.desc("final_segment_risk"), "time_step", "seg_no").limit(k)


def ranked_per_step(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of every step, with their ``rank``.

    The rank filter turns into a partial top-k ahead of the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("time_step").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def top_risks_per_step(fused: DataFrame, k: int = TOP_PER_STEP) -> DataFrame:
    return ranked_per_step(fused, k, F.desc("final_segment_risk"), F.col("seg_no"))


def first_gas_per_step(gas: DataFrame, k: int = GAS_PER_STEP) -> DataFrame:
    return ranked_per_step(gas, k, F.col("sensor_id"), F.col("segment_id"))


def pick_event(fused: DataFrame) -> DataFrame:
    """The riskiest row, among critical ones if there are any."""
    critical = F.col("risk_level") == "CRITICAL"
    order = F.struct(critical, "final_segment_risk", -F.col("time_step"), -F.col("seg_no"))
    row = F.struct("time_step", "segment_id", "risk_level", "final_segment_risk", "reason_breakdown")
    picked = fused.agg(F.max_by(row, order).alias("_e")).where(F.col("_e").isNotNull()).select("_e.*")
    is_critical = F.col("risk_level") == "CRITICAL"
    # Event names.
    return picked.withColumn(
        "event_type",
        F.when(is_critical, F.lit("POTENTIAL_COLLAPSE_OR_UNSAFE_SEGMENT")).otherwise(
            F.lit("HIGHEST_RISK_SEGMENT_ROUTE_STRESS_TEST")
        ),
    ).withColumn(
        "scenario_basis",
        F.when(is_critical, F.lit("critical_risk_threshold")).otherwise(
            F.lit("no_critical_segment_detected_in_local_safe_pass")
        ),
    )


def workers_at(workers: DataFrame, time_step) -> DataFrame:
    """Each worker's row at a step, or the last row of one whose track is shorter.

    Tracks are dense from step 0, so a step without a row lies past the end.
    """
    row = F.struct("time_step", "mapped_segment_id")
    exact = F.max_by(row, F.when(F.col("time_step") == time_step, F.lit(1)))
    return (
        workers.groupBy("worker_id")
        .agg(F.coalesce(exact, F.max_by(row, "time_step")).alias("_r"))
        .select("worker_id", F.col("_r.mapped_segment_id").alias("worker_segment"))
    )


def emergency_scenario(segments: DataFrame, workers: DataFrame, fused: DataFrame, exit_node: str) -> DataFrame:
    """Block the event's segment and decide, per worker, whether the exit is in reach.

    Without any worker a single row stands for one inside the blocked segment.
    """
    event = materialize(pick_event(fused), "event")
    e = one_row(
        event, *[F.first(c).alias(c) for c in event.columns]
    )
    people = workers_at(workers, e["time_step"])
    nobody = event.where(one_row(workers, F.count(F.lit(1)).alias("n"))["n"] == 0).select(
        F.lit(None).cast(workers.schema["worker_id"].dataType).alias("worker_id"),
        F.col("segment_id").alias("worker_segment"),
    )
    block = segments.select(F.col("segment_id").alias("_s"), "from_node")
    origin = segments.join(event.select("segment_id"), "segment_id", "left_semi").select("from_node").scalar()
    placed = materialize(
        people.unionByName(nobody)
        .join(block, F.col("worker_segment") == F.col("_s"), "left")
        .select(
            F.coalesce(F.col("worker_id").cast("string"), F.lit("")).alias("request_id"),
            "worker_id",
            "worker_segment",
            F.coalesce("from_node", origin).alias("start_node"),
            e["segment_id"].alias("blocked_segment"),
        ),
        "placed",
    )
    inside = F.col("worker_segment") == F.col("blocked_segment")
    # Everyone in the same start node shares a route, whoever they are.
    starts = placed.where(~inside).select("start_node", "blocked_segment").distinct()
    routes = hop_routes(segments, starts.withColumn("request_id", F.col("start_node")), exit_node).select(
        "start_node", "route_nodes"
    )
    route = F.when(~inside, F.col("route_nodes"))
    critical = F.col("scenario_basis") == "critical_risk_threshold"
    # Status names.
    status = (
        F.when(critical & inside, F.lit("CRITICAL_WORKER_IN_BLOCKED_SEGMENT"))
        .when(critical & route.isNotNull(), F.lit("ALTERNATIVE_ROUTE_AVAILABLE"))
        .when(critical, F.lit("CRITICAL_WORKER_TRAPPED"))
        .when(inside, F.lit("WORKER_INSIDE_HIGHEST_RISK_SEGMENT_STRESS_TEST"))
        .when(route.isNotNull(), F.lit("STRESS_TEST_ALTERNATIVE_ROUTE_AVAILABLE"))
        .otherwise(F.lit("STRESS_TEST_NO_ROUTE_AVAILABLE"))
    )
    return (
        placed.join(routes, "start_node", "left")
        .withColumn("scenario_basis", e["scenario_basis"])
        .withColumn("event", e)
        .select(
            F.col("event.time_step").alias("time_step"),
            "worker_id",
            "worker_segment",
            "blocked_segment",
            F.lit(exit_node).alias("exit_node"),
            route.isNotNull().alias("exit_reachable_after_blockage"),
            route.alias("alternative_route_to_exit"),
            status.alias("emergency_status"),
            "scenario_basis",
            "event",
        )
    )


def collapse_view(scenario: DataFrame) -> DataFrame:
    """Scenario with canonical ids, in the record and in its nested event."""
    event = F.col("event")
    event = event.withField("segment_id", canonical_segment_id(event["segment_id"]))
    event = event.withField("risk_level", canonical_risk_level(F.col("event.risk_level")))
    return canonical_record(scenario).withColumn("event", event)


def scenario_code(time_step, event_step, event_type, reachable):
    # Scenario codes.
    return (
        F.when(time_step < event_step, F.lit("NORMAL_TIMELINE"))
        .when(time_step == event_step, event_type)
        .when(~reachable, F.lit("WORKER_TRAPPED_AFTER_EVENT"))
        .otherwise(F.lit("WORKER_FOLLOWING_ALTERNATIVE_ROUTE"))
    )


def worker_playback(workers: DataFrame, scenario: DataFrame, last_step) -> DataFrame:
    """Worker state for every step, frozen once trapped, with the scenario code.

    A step missing from a track shows the track's first row. Tables that grow
    with the workers meet by shuffles: stored, the scenario is small enough for
    a broadcast, but its rows are not.
    """
    first = workers.groupBy("worker_id").agg(
        F.min_by(F.struct("mapped_segment_id", "motion_status"), "time_step").alias("_first")
    )
    fate = scenario.select(
        "worker_id",
        F.col("time_step").alias("_event"),
        F.col("event.event_type").alias("_type"),
        F.col("worker_segment").alias("_held"),
        F.col("exit_reachable_after_blockage").alias("_reachable"),
    )
    grid = over_steps(first.join(fate.hint("merge"), "worker_id"), last_step, "worker_id")
    seen = workers.select("worker_id", "time_step", "mapped_segment_id", "motion_status")
    held = (F.col("time_step") >= F.col("_event")) & ~F.col("_reachable")
    return grid.join(seen.hint("merge"), ["worker_id", "time_step"], "left").select(
        "worker_id",
        "time_step",
        F.when(held, F.col("_held"))
        .otherwise(F.coalesce("mapped_segment_id", "_first.mapped_segment_id"))
        .alias("mapped_segment_id"),
        F.when(held, F.lit("trapped"))
        .otherwise(F.coalesce("motion_status", "_first.motion_status"))
        .alias("motion_status"),
        scenario_code(F.col("time_step"), F.col("_event"), F.col("_type"), F.col("_reachable")).alias("scenario_code"),
    )


def worker_trail(playback: DataFrame) -> DataFrame:
    """Segments visited up to and including each step, in order.

    A worker has one row per timeline step, which bounds window and list.
    """
    upto = Window.partitionBy("worker_id").orderBy("time_step").rowsBetween(Window.unboundedPreceding, 0)
    return playback.select(
        "worker_id", "time_step", F.collect_list("mapped_segment_id").over(upto).alias("trail")
    )


def playback_panel(
    fused: DataFrame, workers: DataFrame, scenario: DataFrame
) -> DataFrame:
    """Per step and worker: state, riskiest segment, blockage and route."""
    top = top_risks_per_step(fused, 1).select(
        "time_step",
        F.col("segment_id").alias("top_segment"),
        F.col("final_segment_risk").alias("top_risk"),
        F.col("risk_level").alias("top_level"),
        "reason_breakdown",
    )
    fate = scenario.select(
        "worker_id",
        F.col("time_step").alias("_event"),
        "blocked_segment",
        F.col("exit_reachable_after_blockage").alias("_reachable"),
        "alternative_route_to_exit",
    )
    states = worker_playback(workers, scenario, max_time_step(fused))
    started = F.col("time_step") >= F.col("_event")
    return (
        states.join(fate, "worker_id")
        .join(top, "time_step", "left")
        .select(
            "time_step",
            "worker_id",
            F.col("mapped_segment_id").alias("worker_segment"),
            "motion_status",
            "top_segment",
            "top_risk",
            "top_level",
            "reason_breakdown",
            F.when(started, F.col("blocked_segment")).alias("blocked_segment"),
            F.when(started, F.col("_reachable")).alias("exit_reachable"),
            "scenario_code",
            "alternative_route_to_exit",
        )
    )
