"""Reachability, hop trees and edge-removal impact on the tunnel graph.

Every search starts at the exit: the graph is undirected, so one tree per
scenario answers for all starting points. A round touches the frontier and
its edges only, and is pinned as a table before the next one starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adit.functions.scores import GRAPH_WEIGHTS, exact_round, normalize, risk_level, weighted_sum
from adit.operators.segments import node_degree, nodes
from adit.workspace import loop_folder, materialize, materialize_counted, materialize_measured, new_path, one_row

# Levels of the tree folded upwards per written table.
FOLD_LEVELS = 4
# Doublings of a walk, and of the pointers along passages, per written table.
JUMPS_PER_TABLE, DOUBLINGS_PER_TABLE = 3, 2


def both_ways() -> Column:
    """A segment in its two directions: (way, src, dst), way 1 is backwards."""
    ways = ((0, "from_node", "to_node"), (1, "to_node", "from_node"))
    return F.explode(
        F.array(*[F.struct(F.lit(w).alias("way"), F.col(s).alias("src"), F.col(d).alias("dst")) for w, s, d in ways])
    )


def adjacency(segments: DataFrame, blocked_segment: str | None = None) -> DataFrame:
    """Both directions of every segment, optionally without one segment."""
    kept = segments if blocked_segment is None else segments.where(F.col("segment_id") != blocked_segment)
    length = F.when(F.col("length").isNull() | (F.col("length") == 0), F.lit(1.0)).otherwise(F.col("length"))
    return kept.select("seg_no", "segment_id", length.alias("length"), both_ways().alias("_e")).select(
        "_e.src", "_e.dst", "seg_no", "segment_id", "length"
    )


def open_to(segment: str, blocked: str) -> Column:
    """The segment is not the scenario's blocked one (which may be null)."""
    return ~F.col(segment).eqNullSafe(F.col(blocked))


def hop_tree(segments: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Breadth-first trees, one per row of ``roots`` (scenario, root, blocked_segment).

    Returns (scenario, blocked_segment, node, depth, parent, parent_segment)
    and the number of levels. Among equally short ways a node takes the one
    with the smallest next node, so routes read off the tree are the
    lexicographically smallest shortest ones.
    """
    edges = materialize(
        adjacency(segments).where(F.col("src") != F.col("dst")).select("src", "dst", "seg_no", "segment_id"),
        "adjacency",
    )
    # All levels lie below one folder and are read back as one table.
    spark = segments.sparkSession
    folder = new_path(spark, "levels")
    first = roots.select(
        "scenario",
        "blocked_segment",
        F.col("root").alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("parent_segment"),
    )
    frontier, found = materialize_counted(first, "level", at=f"{folder}/depth=0")
    levels = [frontier]
    while found:
        step = (
            frontier.select("scenario", "blocked_segment", F.col("node").alias("src"))
            .join(edges, "src")
            .where(open_to("segment_id", "blocked_segment"))
            .groupBy("scenario", "blocked_segment", F.col("dst").alias("node"))
            .agg(F.min(F.struct("src", "seg_no", "segment_id")).alias("_via"))
        )
        # Neighbours of level k lie on levels k-1, k and k+1 only.
        for known in levels[-2:]:
            step = step.join(known.select("scenario", "node"), ["scenario", "node"], "left_anti")
        frontier, found = materialize_counted(
            step.select(
                "scenario",
                "blocked_segment",
                "node",
                F.col("_via.src").alias("parent"),
                F.col("_via.segment_id").alias("parent_segment"),
            ),
            "level",
            at=f"{folder}/depth={len(levels)}",
        )
        if found:
            levels.append(frontier)
    tree = spark.read.schema(T.StructType([*first.schema.fields, T.StructField("depth", T.IntegerType())])).parquet(folder)
    return tree, len(levels)


def exit_roots(segments: DataFrame, exit_node: str, blocked_segment: str | None = None) -> DataFrame:
    """A single scenario rooted at the exit."""
    return segments.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("scenario"),
        F.lit(exit_node).alias("root"),
        F.lit(blocked_segment).cast("string").alias("blocked_segment"),
    )


def chains(segments: DataFrame, keep: str) -> DataFrame:
    """Assign every segment to the unbranched passage it is part of.

    Tunnels are mostly passages: nodes with two segments and nothing else.
    Such runs are followed by pointer doubling, so a passage of n segments
    takes log2(n) rounds. Returns the segments with ``chain``, its end nodes
    ``a`` and ``b``, the number of segments ``to_a`` and ``to_b`` up to
    them, this one included, and ``forward``, whether ``to_node`` is the end
    towards ``a``. ``keep`` never lies inside a passage. Segments
    of a ring without any other connection have a null ``chain``.
    """
    loops = segments.where(F.col("from_node") == F.col("to_node")).select(F.col("from_node").alias("node_id"))
    inner = (
        node_degree(segments)
        .where((F.col("degree") == 2) & (F.col("node_id") != keep))
        .join(loops, "node_id", "left_anti")
        .select(F.col("node_id").alias("dst"), F.lit(True).alias("_inner"))
    )
    # An arc is a segment in one direction: 2 * seg_no, or that plus 1 backwards.
    ways = segments.select("seg_no", both_ways().alias("_w")).select("seg_no", "_w.*")
    arcs = ways.withColumn("arc", F.col("seg_no") * 2 + F.col("way")).join(inner, "dst", "left")
    onward = arcs.select(F.col("src").alias("_at"), F.col("arc").alias("next"), F.col("seg_no").alias("_seg"))
    on = (F.col("dst") == F.col("_at")) & (F.col("seg_no") != F.col("_seg")) & F.col("_inner")
    pending = F.col("next").isNotNull()
    state, open_ = materialize_counted(
        arcs.join(onward, on, "left").select(
            "arc", "next", F.lit(1).cast("bigint").alias("steps"), F.col("arc").alias("last"), F.col("dst").alias("end")
        ),
        "passages",
        pending,
    )
    before = None
    # Every round ends some arcs of each unfinished passage; if none, only rings are left.
    while open_ and open_ != before:
        before = open_
        for _ in range(DOUBLINGS_PER_TABLE):
            ahead = state.select(
                F.col("arc").alias("_arc"),
                F.col("next").alias("_next"),
                F.col("steps").alias("_steps"),
                F.col("last").alias("_last"),
                F.col("end").alias("_end"),
            )
            state = state.join(ahead, F.col("next") == F.col("_arc"), "left").select(
                "arc",
                F.col("_next").alias("next"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.coalesce("_last", "last").alias("last"),
                F.coalesce("_end", "end").alias("end"),
            )
        state, open_ = materialize_counted(state, "passages", pending)
    ended = state.where(~pending)
    ahead = ended.select(
        F.shiftright("arc", 1).alias("seg_no"), (F.col("arc") % 2).alias("_way"), "steps", "last", "end"
    )
    forward = ahead.where("_way = 0").select("seg_no", F.struct("last", F.col("end"), "steps").alias("_f"))
    backward = ahead.where("_way = 1").select("seg_no", F.struct("last", F.col("end"), "steps").alias("_b"))
    low, high = F.least("_f", "_b"), F.greatest("_f", "_b")
    sides = forward.join(backward, "seg_no").select(
        "seg_no",
        low["last"].alias("chain"),
        high["end"].alias("a"),
        low["end"].alias("b"),
        high["steps"].alias("to_a"),
        low["steps"].alias("to_b"),
        (F.col("_f") == high).alias("forward"),
    )
    return materialize(segments.join(sides, "seg_no", "left"), "chains")


def passages(chained: DataFrame) -> DataFrame:
    """One segment-like row per chain, from end to end, with its inner ``span``."""
    return materialize(
        chained.where(F.col("chain").isNotNull())
        .groupBy("chain", "a", "b")
        .agg(F.max(F.col("to_a") + F.col("to_b") - 2).alias("span"))
        .select(
            F.col("chain").alias("seg_no"),
            F.col("chain").cast("string").alias("segment_id"),
            F.col("a").alias("from_node"),
            F.col("b").alias("to_node"),
            F.lit(1.0).alias("length"),
            "span",
        ),
        "passage-graph",
    )


def reachable_nodes(segments: DataFrame, start: str, blocked_segment: str | None = None) -> DataFrame:
    """Nodes connected to ``start``, itself included."""
    open_ = segments if blocked_segment is None else segments.where(F.col("segment_id") != blocked_segment)
    chained = chains(open_, start)
    tree, _ = hop_tree(passages(chained), exit_roots(segments, start))
    ends = tree.select("node")
    along = chained.join(ends, F.col("a") == F.col("node"), "left_semi")
    return ends.unionByName(along.select(F.explode(F.array("from_node", "to_node")).alias("node"))).distinct()


def unreached_nodes(segments: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes(segments).join(reached, F.col("node_id") == F.col("node"), "left_anti")


def _by_depth(tree: DataFrame) -> DataFrame:
    """``tree`` as a table in which a level is a folder."""
    path = new_path(tree.sparkSession, "by-depth")
    tree.repartition("depth").write.partitionBy("depth").parquet(path)
    return tree.sparkSession.read.schema(tree.schema).parquet(path)


def edge_impact(segments: DataFrame, exit_node: str) -> DataFrame:
    """Per segment, how many nodes lose the exit when it is removed.

    One search instead of one per segment, on the graph of whole passages.
    Each passage outside the search tree gets a random 128-bit label that is
    XORed into its two end nodes; the XOR over a subtree is zero exactly when
    no such passage leaves it, i.e. when the subtree hangs on its own passage
    alone (cycle space sampling, Pritchard and Thurimella 2011; the chance of
    a false zero is 2^-128 per passage). Cutting a segment of that passage
    loses the subtree and the nodes between the cut and it. Nodes the exit
    never reaches count for every segment.
    """
    chained = chains(segments, exit_node)
    graph = passages(chained)
    tree, levels = hop_tree(graph, exit_roots(segments, exit_node))
    spans = graph.select(F.col("segment_id").alias("parent_segment"), "span")
    chosen = tree.where(F.col("parent_segment").isNotNull()).select(F.col("parent_segment").alias("segment_id"))
    rest = graph.join(chosen, "segment_id", "left_anti")
    # A passage outside the tree has both ends in a cut-off subtree or none,
    # so its inner nodes may be counted at either end.
    marks = (
        rest.select(
            F.explode(
                F.array(
                    F.struct(F.col("from_node").alias("node"), F.col("span").alias("n")),
                    F.struct(F.col("to_node").alias("node"), F.lit(0).cast("bigint").alias("n")),
                )
            ).alias("_m"),
            F.xxhash64("seg_no", F.lit(1)).alias("_x1"),
            F.xxhash64("seg_no", F.lit(2)).alias("_x2"),
        )
        .groupBy("_m.node")
        .agg(F.bit_xor("_x1").alias("_x1"), F.bit_xor("_x2").alias("_x2"), F.sum("_m.n").alias("_own"))
    )
    zero = F.lit(0).cast("bigint")
    labelled = _by_depth(
        tree.join(marks, "node", "left")
        .join(spans, "parent_segment", "left")
        .select(
            "node",
            "depth",
            "parent",
            "parent_segment",
            F.coalesce("_x1", zero).alias("_x1"),
            F.coalesce("_x2", zero).alias("_x2"),
            (F.coalesce("_own", zero) + 1).alias("_size"),
            F.coalesce("span", zero).alias("_span"),
        )
    )
    folded: list[DataFrame] = []
    below: DataFrame | None = None
    todo = list(range(levels - 1, 0, -1))
    for at in range(0, len(todo), FOLD_LEVELS):
        batch = []
        for depth in todo[at : at + FOLD_LEVELS]:
            level = labelled.where(F.col("depth") == depth)
            if below is not None:
                carried = below.groupBy(F.col("parent").alias("node")).agg(
                    F.sum(F.col("_size") + F.col("_span")).alias("_s"),
                    F.bit_xor("_x1").alias("_b1"),
                    F.bit_xor("_x2").alias("_b2"),
                )
                level = level.join(carried, "node", "left").select(
                    "node",
                    "depth",
                    "parent",
                    "parent_segment",
                    F.col("_x1").bitwiseXOR(F.coalesce("_b1", zero)).alias("_x1"),
                    F.col("_x2").bitwiseXOR(F.coalesce("_b2", zero)).alias("_x2"),
                    (F.col("_size") + F.coalesce("_s", zero)).alias("_size"),
                    "_span",
                )
            batch.append(level)
            below = level
        done = materialize(reduce(DataFrame.unionByName, batch), "folded")
        folded.append(done)
        below = done.where(F.col("depth") == todo[min(at + FOLD_LEVELS, len(todo)) - 1])

    total = one_row(nodes(segments), F.count(F.lit(1)).alias("n"))["n"]
    ends = tree.join(nodes(segments), F.col("node") == F.col("node_id"), "left_semi")
    inside = graph.join(tree.select("node"), F.col("from_node") == F.col("node"), "left_semi")
    reached = F.coalesce(one_row(ends, F.count(F.lit(1)).alias("n"))["n"], zero) + F.coalesce(
        one_row(inside, F.sum("span").alias("n"))["n"], zero
    )
    result = chained
    if folded:
        bridges = (
            reduce(DataFrame.unionByName, folded)
            .where((F.col("_x1") == 0) & (F.col("_x2") == 0))
            .select(F.col("parent_segment").cast("bigint").alias("chain"), F.col("node").alias("_far"), "_size")
        )
        beyond = F.when(F.col("_far") == F.col("b"), F.col("to_b")).otherwise(F.col("to_a")) - 1
        result = result.join(bridges, "chain", "left").withColumn("_cut", F.col("_size") + beyond)
    else:
        result = result.withColumn("_cut", zero)
    return result.select(
        *segments.columns,
        (F.coalesce("_cut", zero) + total - reached).cast("bigint").alias("disconnected_node_count"),
        total.alias("total_node_count"),
    )


def graph_risk(segments: DataFrame, impact: DataFrame) -> DataFrame:
    """Blocking, chokepoint and length scores per segment, weighted and banded.

    ``impact`` is the result of :func:`edge_impact`.
    """
    length = F.coalesce(F.col("length"), F.lit(0.0))
    span = one_row(segments, F.min(length).alias("lo"), F.max(length).alias("hi"))
    scored = (
        impact.withColumn(
            "graph_blocking_score",
            F.col("disconnected_node_count") / F.greatest(F.lit(1), F.col("total_node_count")) * 100.0,
        )
        .withColumn("chokepoint_score", F.when(F.col("is_chokepoint"), F.lit(100.0)).otherwise(F.lit(0.0)))
        .withColumn("length_score", normalize(length, span["lo"], span["hi"]))
        .withColumn("_score", weighted_sum(GRAPH_WEIGHTS))
    )
    return scored.select(
        "seg_no",
        "segment_id",
        "from_node",
        "to_node",
        "length",
        "is_chokepoint",
        "disconnected_node_count",
        "total_node_count",
        exact_round(F.col("graph_blocking_score"), 3).alias("graph_blocking_score"),
        exact_round(F.col("chokepoint_score"), 3).alias("chokepoint_score"),
        exact_round(F.col("length_score"), 3).alias("length_score"),
        exact_round(F.col("_score"), 3).alias("graph_risk_score"),
        risk_level(F.col("_score")).alias("risk_level"),
    )


def leaps(tree: DataFrame, keys: list[str], folder: str) -> list[DataFrame]:
    """Tables (keys, node, to) that lead 1, 2, 4 ... steps up, until nothing is that deep."""
    leap = tree.where("parent IS NOT NULL").select(*keys, "node", F.col("parent").alias("to"))
    found, nth = [], F.col("_nth")
    while len(found) % JUMPS_PER_TABLE == 0:
        batch = [leap]
        for _ in range(1, JUMPS_PER_TABLE):
            batch.append(_twice(batch[-1], keys))
        stacked = reduce(DataFrame.unionByName, [b.withColumn("_nth", F.lit(k)) for k, b in enumerate(batch)])
        table, deepest = materialize_measured(stacked, "leaps", F.coalesce(F.max(nth), F.lit(-1)), inside=folder)
        found += [table.where(nth == k).drop("_nth") for k in range(deepest + 1)]
        if deepest < 0:
            break
        leap = _twice(found[-1], keys)
    return found


def _twice(leap: DataFrame, keys: list[str]) -> DataFrame:
    further = leap.select(*keys, F.col("node").alias("to"), F.col("to").alias("_to"))
    return leap.join(further, [*keys, "to"]).select(*keys, "node", F.col("_to").alias("to"))


def walk(starts: DataFrame, tree: DataFrame, jumps: list[DataFrame] | None = None) -> DataFrame:
    """Follow parents from each start node to the root, or out of the tree.

    ``starts``: (request_id, scenario, node); requests whose node is not in
    the tree drop out. Adds ``route_nodes`` and ``route_segments``, the
    ``parent_segment`` of each but the last.

    After k rounds every request has the nodes less than 2^k steps ahead, one
    row each; ``jumps`` are the :func:`leaps` of the tree, if there are any yet.
    """
    up = tree.select("scenario", "node", "parent", F.col("parent_segment").alias("via"))
    with loop_folder(tree.sparkSession, "walk") as folder:
        if jumps is None:
            jumps = leaps(up, ["scenario"], folder)
        here = starts.join(up.select("scenario", "node"), ["scenario", "node"], "left_semi")
        known = here.select("request_id", "scenario", F.lit(0).alias("at"), "node")
        for k, leap in enumerate(jumps):
            ahead = known.join(leap, ["scenario", "node"]).select("request_id", "scenario", (F.col("at") + (1 << k)).alias("at"), F.col("to").alias("node"))
            known = known.unionByName(ahead)
            if k % JUMPS_PER_TABLE == JUMPS_PER_TABLE - 1 and k + 1 < len(jumps):
                known = materialize(known, "places", inside=folder)
        passed = known.join(up.select("scenario", "node", "via"), ["scenario", "node"], "left")
        route = F.sort_array(F.collect_list(F.struct("at", "node", "via")))
        routes = passed.groupBy("request_id", "scenario").agg(route.alias("r"))
        taken = F.filter(F.col("r.via"), lambda v: v.isNotNull())
        return materialize(routes.select("request_id", "scenario", F.col("r.node").alias("route_nodes"), taken.alias("route_segments")), "routes")
