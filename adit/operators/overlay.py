"""Cheapest routes on the graph of whole passages.

Tunnels are mostly unbranched passages. A search runs on passage ends only,
over passages that weigh what their segments weigh together; places inside a
passage are reached by the prefix sums of its weights, and the segments of a
route are filled in by one join at the end. The rounds of a search follow the
junctions on a route and not its segments.

A cut breaks one passage. If the tree of the search uses it, only the ends
below it are searched again, starting from their untouched neighbours; all
segments of a passage share that search.

Costs are whole numbers, so a sum is the same from either end and ties are
ties. Of equally cheap ways the one with fewer segments is taken, then the one
with the smaller next node, then with the lower segment number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.operators.graph import JUMPS_PER_TABLE, chains, leaps, walk
from adit.operators.running import running_totals
from adit.workspace import loop_folder, materialize, materialize_counted

#: Costs are counted in billionths.
UNIT = 1e9
NO_BLOCK = ""
STEP = ["time_step"]
CUT = ["time_step", "cut"]
#: Relaxations per written table, and tables between two merges of what a search knows.
RELAXATIONS, TABLES_PER_MERGE = 3, 6


def whole_cost(weight: Column) -> Column:
    return F.round(weight * UNIT).cast("long")


@dataclass(frozen=True)
class Overlay:
    """``line``: the segments of every passage and step in order, with the cost before them.

    (time_step, chain, pos, size, a, b, near, far, seg_no, segment_id, weight,
    cost, before); ``pos`` counts segments from end ``a`` on, ``near`` and
    ``far`` are its ends as seen from there. ``links``: a row per step, passage
    and direction: (time_step, node, dst, chain, down, cost, hops, via); ``down``
    leads to end ``a``, ``via`` is the first (next node, segment number) on the
    way. Passages that return to where they begin have no links.
    """

    line: DataFrame
    links: DataFrame


def overlay(segments: DataFrame, weights: DataFrame, keep: str) -> Overlay:
    """``weights``: (time_step, seg_no, weight), one row per step and segment."""
    chained = chains(segments, keep).where(F.col("chain").isNotNull())
    places = chained.select(
        "seg_no",
        "segment_id",
        "chain",
        F.col("to_a").alias("pos"),
        (F.col("to_a") + F.col("to_b") - 1).alias("size"),
        "a",
        "b",
        F.when(F.col("forward"), F.col("to_node")).otherwise(F.col("from_node")).alias("near"),
        F.when(F.col("forward"), F.col("from_node")).otherwise(F.col("to_node")).alias("far"),
    )
    placed = weights.join(places, "seg_no").withColumn("cost", whole_cost(F.col("weight")))
    summed = running_totals(placed, {"before": "cost"}, ["pos"], ["time_step", "chain"])
    line = materialize(
        summed.select("time_step", "chain", "pos", "size", "a", "b", "near", "far", "seg_no", "segment_id", "weight", "cost", "before"), "line"
    )
    first, last = F.col("pos") == 1, F.col("pos") == F.col("size")
    passages = line.groupBy("time_step", "chain", "a", "b").agg(
        F.sum("cost").alias("cost"),
        F.max("size").cast("int").alias("hops"),
        F.max(F.when(first, F.struct(F.col("far").alias("next"), "seg_no"))).alias("from_a"),
        F.max(F.when(last, F.struct(F.col("near").alias("next"), "seg_no"))).alias("from_b"),
    )
    ways = [
        F.struct(F.col(x).alias("node"), F.col(y).alias("dst"), F.lit(down).alias("down"), F.col(f"from_{x}").alias("via"))
        for x, y, down in (("a", "b", False), ("b", "a", True))
    ]
    links = passages.where("a <> b").select("time_step", "chain", "cost", "hops", F.explode(F.array(*ways)).alias("w"))
    return Overlay(line, materialize(links.select("time_step", "w.node", "w.dst", "chain", "w.down", "cost", "hops", "w.via"), "links"))


def settle(state: DataFrame, links: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Relax costs along ``links`` until no node improves.

    ``state``: keys, node, cost, hops of the nodes known so far. A node takes
    over from its neighbour ``dst``. A table holds what got better within a few
    relaxations and goes on from what came with the last of them.
    """
    ahead = links.select(*keys, "node", "dst", F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    # Of equal ways the one of an earlier relaxation counts: it was followed already.
    known = [state.select(*keys, "node", F.struct("cost", "hops", F.lit(0).alias("nth")).alias("_b"))]
    frontier, improved = known[0], 1
    while improved:
        steps = []
        for nth in range(1, RELAXATIONS + 1):
            cost = F.struct((F.col("_b.cost") + F.col("_c")).alias("cost"), (F.col("_b.hops") + F.col("_h")).alias("hops"), F.lit(nth).alias("nth"))
            frontier = frontier.withColumnRenamed("node", "dst").join(ahead, [*keys, "dst"]).groupBy(*keys, "node").agg(F.min(cost).alias("_b"))
            steps.append(frontier)
        reached = reduce(DataFrame.unionByName, steps).groupBy(*keys, "node").agg(F.min("_b").alias("_b"))
        old = best_known(known, keys).select(*keys, "node", F.struct("_b.cost", "_b.hops").alias("_old"))
        gain = F.struct("_b.cost", "_b.hops") < F.col("_old")
        better = reached.join(old, [*keys, "node"], "left").where(F.col("_old").isNull() | gain).drop("_old")
        last = F.col("_b.nth") == RELAXATIONS
        found, improved = materialize_counted(better, "costs", last, inside=folder)
        known.append(found)
        frontier = found.where(last)
        if len(known) > TABLES_PER_MERGE:
            known = [materialize(best_known(known, keys), "costs", inside=folder)]
    return best_known(known, keys).select(*keys, "node", "_b.cost", "_b.hops")


def best_known(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy(*keys, "node").agg(F.min("_b").alias("_b"))


def with_parents(costs: DataFrame, links: DataFrame, ahead: DataFrame, keys: list[str]) -> DataFrame:
    """The tree behind settled costs: keys, node, cost, hops, parent and ``leg``, the (chain, down) that leads there.

    ``ahead`` has the costs of everything that a link can lead to.
    """
    toward = ahead.select(*keys, F.col("node").alias("dst"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    ways = links.select(*keys, "node", "dst", "via", "chain", "down", F.col("cost").alias("_w"), F.col("hops").alias("_n"))
    parents = (
        costs.join(ways, [*keys, "node"])
        .join(toward, [*keys, "dst"])
        .where((F.col("cost") == F.col("_c") + F.col("_w")) & (F.col("hops") == F.col("_h") + F.col("_n")))
        .groupBy(*keys, "node")
        .agg(F.min(F.struct("via", "dst", "chain", "down")).alias("_p"))
    )
    return costs.join(parents, [*keys, "node"], "left").select(
        *keys, "node", "cost", "hops", F.col("_p.dst").alias("parent"), F.when(F.col("_p").isNotNull(), F.struct("_p.chain", "_p.down")).alias("leg")
    )


def search(graph: Overlay, exit_node: str) -> DataFrame:
    """The tree of passage ends from the exit, per step."""
    exits = graph.line.select("time_step").distinct().select(
        "time_step", F.lit(exit_node).alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops")
    )
    with loop_folder(graph.line.sparkSession, "search") as folder:
        costs = settle(exits, graph.links, STEP, folder)
        return materialize(with_parents(costs, graph.links, costs, STEP), "tree")


def descendants(tops: DataFrame, jumps: list[DataFrame], folder: str) -> DataFrame:
    """(time_step, cut, node) of all nodes at or below each top (time_step, cut, node).

    ``jumps`` lead from each node 1, 2, 4 ... steps up, so after k of them all
    nodes less than 2^k steps below are found.
    """
    found = tops
    for k, jump in enumerate(jumps, 1):
        below = jump.join(found.withColumnRenamed("node", "to"), ["time_step", "to"]).select(*CUT, "node")
        found = found.unionByName(below)
        if k % JUMPS_PER_TABLE == 0 or k == len(jumps):
            found = materialize(found, "found", inside=folder)
    return found


def detours(graph: Overlay, base: DataFrame, jumps: list[DataFrame], cuts: DataFrame, folder: str) -> DataFrame:
    """For each cut passage (time_step, cut) that the tree uses, new rows for the ends below it.

    Ends without another way to the exit have null cost and hops.
    """
    tops = base.where(F.col("leg").isNotNull()).select("time_step", F.col("leg.chain").alias("cut"), "node").join(cuts, CUT, "left_semi")
    affected = descendants(tops, jumps, folder)
    inside = affected.select(*CUT, F.col("node").alias("dst"), F.lit(True).alias("_inside"))
    untouched = base.select("time_step", F.col("node").alias("dst"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    ways = materialize(
        affected.join(graph.links, ["time_step", "node"])
        .where(F.col("chain") != F.col("cut"))
        .join(untouched, ["time_step", "dst"], "left")
        .join(inside, [*CUT, "dst"], "left"),
        "detours",
        inside=folder,
    )
    within, rim = ways.where("_inside").drop("_inside"), ways.where("_inside IS NULL AND _c IS NOT NULL").drop("_inside")
    entry = F.struct((F.col("_c") + F.col("cost")).alias("cost"), (F.col("_h") + F.col("hops")).alias("hops"))
    seeds = rim.groupBy(*CUT, "node").agg(F.min(entry).alias("_e")).select(*CUT, "node", "_e.cost", "_e.hops")
    costs = settle(seeds, within, CUT, folder)
    around = rim.select(*CUT, F.col("dst").alias("node"), F.col("_c").alias("cost"), F.col("_h").alias("hops")).distinct()
    both = within.unionByName(rim).drop("_c", "_h")
    tree = with_parents(costs, both, costs.unionByName(around), CUT)
    return materialize(affected.join(tree, [*CUT, "node"], "left"), "detour-tree")


def first_legs(graph: Overlay, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Ways from each start to a passage end.

    ``starts``: (start_id, time_step, node), ``ends`` lists the ends per step.
    Returns start_id, time_step, end, start_node, chain, down, pos, cost, hops, via; a start
    that is an end itself has one row without a chain, one inside a passage two.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("chain", "bigint"), ("down", "boolean"), ("pos", "bigint"))]
    no_via = F.lit(None).cast("struct<next: string, seg_no: bigint>").alias("via")
    at_end = starts.join(ends, ["time_step", "node"], "left_semi").select(
        "start_id", "time_step", F.col("node").alias("end"), F.col("node").alias("start_node"), *none, F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops"), no_via
    )
    # The far node of every segment but the last of its passage lies inside.
    inner = graph.line.where("pos < size").select("time_step", F.col("far").alias("node"), "chain", "pos", "size", "a", "b", F.col("near").alias("_back"), F.col("seg_no").alias("_seg"), (F.col("before") + F.col("cost")).alias("_upto"))
    onward = graph.line.select("time_step", "chain", (F.col("pos") - 1).alias("pos"), F.col("far").alias("_on"), F.col("seg_no").alias("_next"))
    whole = graph.links.select("time_step", "chain", F.col("cost").alias("_all")).distinct()
    loops = graph.line.where("a = b").groupBy("time_step", "chain").agg(F.sum("cost").alias("_all"))
    inside = starts.join(inner, ["time_step", "node"]).join(onward, ["time_step", "chain", "pos"]).join(whole.unionByName(loops), ["time_step", "chain"])
    ways = F.array(
        F.struct(F.col("a").alias("end"), F.lit(True).alias("down"), F.col("_upto").alias("cost"), F.col("pos").cast("int").alias("hops"), F.struct(F.col("_back").alias("next"), F.col("_seg").alias("seg_no")).alias("via")),
        F.struct(F.col("b").alias("end"), F.lit(False).alias("down"), (F.col("_all") - F.col("_upto")).alias("cost"), (F.col("size") - F.col("pos")).cast("int").alias("hops"), F.struct(F.col("_on").alias("next"), F.col("_next").alias("seg_no")).alias("via")),
    )
    inside = inside.select("start_id", "time_step", F.col("node").alias("start_node"), "chain", "pos", F.explode(ways).alias("w"))
    return at_end.unionByName(inside.select("start_id", "time_step", "w.end", "start_node", "chain", "w.down", "pos", "w.cost", "w.hops", "w.via"))


def cheapest(options: DataFrame) -> DataFrame:
    """Of each start's options, with the cost ``_c`` and hops ``_h`` from their end on, the best."""
    total = F.struct((F.col("cost") + F.col("_c")).alias("cost"), (F.col("hops") + F.col("_h")).alias("hops"), "via", "end", "chain", "down", "pos", "start_node", "time_step")
    return options.where(F.col("_c").isNotNull()).groupBy("start_id").agg(F.min(total).alias("_t")).select("start_id", *[f"_t.{c}" for c in ("time_step", "end", "start_node", "chain", "down", "pos")])


def legs_from(places: DataFrame, tree: DataFrame, keys: list[str], jumps: list[DataFrame] | None = None) -> DataFrame:
    """(keys, node, legs, last) from each place (keys, node) up its tree: the legs and the last node reached."""
    scenario = F.struct(*keys).alias("scenario")
    up = tree.select(scenario, "node", "parent", F.col("leg").alias("parent_segment"))
    asked = places.select(*keys, "node").distinct().select(F.struct(*keys, "node").alias("request_id"), scenario, "node")
    keyed = None if jumps is None else [j.select(scenario, "node", "to") for j in jumps]
    walked = walk(asked, up, keyed)
    return walked.select("request_id.*", F.col("route_segments").alias("legs"), F.element_at("route_nodes", -1).alias("last"))


def spelled_out(graph: Overlay, routes: DataFrame) -> DataFrame:
    """Nodes, segments and weights of routes (start_id, time_step, start_node, chain, down, pos, legs)."""
    none = F.array().cast("array<struct<chain: bigint, down: boolean, pos: bigint>>")
    begin = F.when(F.col("chain").isNotNull(), F.array(F.struct("chain", "down", "pos"))).otherwise(none)
    # A whole passage is entered at an end: position 0, or beyond every segment.
    rest = F.transform("legs", lambda x: F.struct(x["chain"].alias("chain"), x["down"].alias("down"), F.when(x["down"], F.lit(1 << 62)).otherwise(F.lit(0)).cast("long").alias("pos")))
    every = routes.select("start_id", "time_step", "start_node", F.concat(begin, rest).alias("legs"))
    on_way = every.select("start_id", "time_step", F.posexplode("legs").alias("at", "leg")).select("start_id", "time_step", "at", "leg.chain", "leg.down", F.col("leg.pos").alias("_from"))
    members = graph.line.select("time_step", "chain", "pos", "near", "far", "segment_id", "weight")
    passed = F.when(F.col("down"), F.col("pos") <= F.col("_from")).otherwise(F.col("pos") > F.col("_from"))
    step = F.struct(
        "at",
        F.when(F.col("down"), -F.col("pos")).otherwise(F.col("pos")).alias("order"),
        F.when(F.col("down"), F.col("near")).otherwise(F.col("far")).alias("node"),
        F.col("segment_id").alias("segment"),
        "weight",
    )
    walked = on_way.join(members, ["time_step", "chain"]).where(passed).groupBy("start_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))

    def field(name: str, kind: str) -> Column:
        return F.coalesce(F.col(f"steps.{name}"), F.array().cast(f"array<{kind}>"))

    return every.select("start_id", "start_node").join(walked, "start_id", "left").select(
        "start_id",
        F.concat(F.array("start_node"), field("node", "string")).alias("route_nodes"),
        field("segment", "string").alias("route_segments"),
        field("weight", "double").alias("weights"),
    )


def best_routes(segments: DataFrame, weights: DataFrame, exit_node: str, starts: DataFrame) -> DataFrame:
    """Routes for (start_id, time_step, blocked_segment, node); '' blocks nothing.

    ``weights``: (time_step, seg_no, weight). Returns start_id, route_nodes,
    route_segments, weights; starts without a way to the exit drop out.
    """
    taken, routes = shared_routes(segments, weights, exit_node, starts)
    return taken.join(routes, "route").select("start_id", "route_nodes", "route_segments", "weights")


def shared_routes(segments: DataFrame, weights: DataFrame, exit_node: str, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`best_routes`, in two tables: (start_id, route) and (route, route_nodes, route_segments, weights).

    Starts at one place and step share a route, if it avoids what is blocked for
    them or the same is blocked. A route that is not in the second table does not exist.
    """
    graph = overlay(segments, weights, exit_node)
    base = search(graph, exit_node)
    with loop_folder(segments.sparkSession, "ways") as folder:
        return _answered(graph, base, leaps(base, STEP, folder), starts, folder)


def _answered(graph: Overlay, base: DataFrame, jumps: list[DataFrame], starts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = starts.select("time_step", "node").distinct().select(F.struct("time_step", "node").alias("start_id"), "time_step", "node")
    ends = base.select("time_step", "node")
    reach = base.select("time_step", F.col("node").alias("end"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    options = materialize(first_legs(graph, asked, ends), "options", inside=folder)
    plain = cheapest(options.join(reach, ["time_step", "end"]))
    # All legs of the way from an end, for the ends that anyone heads for.
    heads = options.select("time_step", F.col("end").alias("node"))
    ahead = legs_from(heads, base, STEP, jumps).select("time_step", F.col("node").alias("end"), "legs")
    plain = plain.join(ahead, ["time_step", "end"]).select(F.col("start_id.node").alias("node"), "time_step", "start_node", "chain", "down", "pos", "legs")
    plain = materialize(plain, "plain", inside=folder)

    cut_at = graph.line.select("time_step", F.col("segment_id").alias("blocked_segment"), F.col("chain").alias("cut"), F.col("pos").alias("cut_pos"))
    taken = starts.join(plain, ["time_step", "node"]).join(cut_at, ["time_step", "blocked_segment"], "left")
    on_first = (F.col("chain") == F.col("cut")) & F.when(F.col("down"), F.col("cut_pos") <= F.col("pos")).otherwise(F.col("cut_pos") > F.col("pos"))
    hit = F.coalesce(on_first, F.lit(False)) | F.coalesce(F.exists("legs", lambda x: x["chain"] == F.col("cut")), F.lit(False))
    taken, n_hit = materialize_counted(taken.withColumn("hit", hit).select("start_id", _route(F.col("hit")).alias("route")), "taken", F.col("route.hit"))
    shape = ["start_id", "time_step", "start_node", "chain", "down", "pos", "legs"]
    routes = plain.withColumns({"cut": F.lit(0), "cut_pos": F.lit(0)}).withColumn("start_id", _route(F.lit(False))).select(*shape)
    if n_hit:
        hits = taken.where("route.hit").select("route").distinct().select(F.col("route").alias("start_id"), "route.*")
        hits = materialize(hits, "hits", inside=folder)
        routes = routes.unionByName(_around(graph, base, jumps, options, reach, hits, folder).select(*shape))
    return taken, materialize(spelled_out(graph, routes).withColumnRenamed("start_id", "route"), "routes")


def _route(hit: Column) -> Column:
    """Name of the route of a start: its place, and what to avoid if it would be met."""
    avoided = [F.when(hit, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("cut", "cut_pos")]
    return F.struct("time_step", "node", hit.alias("hit"), *avoided)


def _around(graph: Overlay, base: DataFrame, jumps: list[DataFrame], options: DataFrame, reach: DataFrame, hit: DataFrame, folder: str) -> DataFrame:
    """Ways of the starts whose own way is cut."""
    moved = detours(graph, base, jumps, hit.select(*CUT).distinct(), folder)
    new_reach = moved.select(*CUT, F.col("node").alias("end"), F.col("cost").alias("_c2"), F.col("hops").alias("_h2"), F.lit(True).alias("_moved"))
    again = hit.select("start_id", "time_step", "node", "cut", "cut_pos").join(
        options.select("time_step", F.col("start_id.node").alias("node"), "end", "start_node", "chain", "down", "pos", "cost", "hops", "via"), ["time_step", "node"]
    )
    shut = (F.col("chain") == F.col("cut")) & F.when(F.col("down"), F.col("cut_pos") <= F.col("pos")).otherwise(F.col("cut_pos") > F.col("pos"))
    again = again.where(~F.coalesce(shut, F.lit(False))).join(reach, ["time_step", "end"], "left").join(new_reach, [*CUT, "end"], "left")
    again = again.withColumn("_c", F.when(F.col("_moved"), F.col("_c2")).otherwise(F.col("_c"))).withColumn("_h", F.when(F.col("_moved"), F.col("_h2")).otherwise(F.col("_h")))
    chosen = cheapest(again).join(hit.select("start_id", "cut"), "start_id")
    chosen = materialize(chosen, "rechosen", inside=folder)
    # From a moved end up the new tree, until it leaves it; from there as before.
    tree = moved.where(F.col("cost").isNotNull()).select(*CUT, "node", "parent", "leg")
    off = chosen.select(*CUT, F.col("end").alias("node"))
    head = legs_from(off, tree, CUT).select(*CUT, F.col("node").alias("end"), F.col("legs").alias("_head"), F.col("last").alias("_last"))
    routes = chosen.join(head, [*CUT, "end"], "left").withColumn("_last", F.coalesce("_last", "end"))
    routes = materialize(routes, "heads", inside=folder)
    rest = legs_from(routes.select("time_step", F.col("_last").alias("node")), base, STEP, jumps).select("time_step", F.col("node").alias("_last"), F.col("legs").alias("_rest"))
    none = F.array().cast("array<struct<chain: bigint, down: boolean>>")
    return routes.join(rest, ["time_step", "_last"]).withColumn("legs", F.concat(F.coalesce("_head", none), "_rest"))
