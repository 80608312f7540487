"""Exact nearest segment centre per position, without comparing all pairs.

Centres are numbered along a space-filling curve and packed into a tree: a leaf
holds 64 consecutive centres, a node 64 consecutive nodes. Its depth follows
their number alone. Positions descend it with the bounding boxes of the
children in their row; a child stays if it can hold something nearer than the
farthest corner of the best box met so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.operators.indexing import ordered_index
from adit.workspace import materialize_counted, one_row

FANOUT = 64
CURVE_BITS = 20


def _curve(places: DataFrame, axes) -> Column:
    """Bits of the scaled coordinates in turn."""
    span = one_row(places, *[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))])
    code = F.lit(0).cast("bigint")
    for k, a in enumerate(axes):
        width = span[f"hi_{a}"] - span[f"lo_{a}"]
        share = F.when(width > 0, (F.col(a) - span[f"lo_{a}"]) / width).otherwise(F.lit(0.0))
        cell = F.least(F.lit(2**CURVE_BITS - 1), F.floor(share * 2**CURVE_BITS)).cast("bigint")
        for bit in range(CURVE_BITS):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), bit * len(axes) + k))
    return code


def _sum(cols) -> Column:
    return reduce(lambda p, q: p + q, cols)


def nearest_segment(positions: DataFrame, centres: DataFrame, axes=("x", "y", "z")) -> DataFrame:
    """``positions`` (pos_id + axes) with ``segment_id`` and ``distance``.

    ``centres``: segment_id, seg_no + axes. Ties go to the smaller seg_no. A
    position with a null coordinate, or any without centres, gets nulls.
    """
    # One entry per place: co-located centres can never beat the first.
    places = centres.dropna(subset=list(axes)).groupBy(*axes).agg(F.min(F.struct("seg_no", "segment_id")).alias("_s"))
    curved = places.withColumn("_m", _curve(places, axes))
    numbered, n = materialize_counted(ordered_index(curved, ["_m", *axes], out="_no"), "centres")
    if not n:
        return positions.withColumns({"segment_id": F.lit(None).cast("string"), "distance": F.lit(None).cast("double")})
    levels = 1
    while FANOUT**levels < n:
        levels += 1

    row = F.struct(*positions.columns).alias("_row")
    at = positions.select("pos_id", *axes, row, F.lit(0).cast("bigint").alias("_node"), F.lit(float("inf")).alias("_limit"))
    for level in range(levels - 1, 0, -1):
        node = F.floor(F.col("_no") / FANOUT**level).cast("bigint")
        boxes = numbered.groupBy(node.alias("_child")).agg(
            *[f(a).alias(f"{e}_{a}") for a in axes for f, e in ((F.min, "lo"), (F.max, "hi"))]
        )
        parent = F.floor(F.col("_child") / FANOUT).cast("bigint")
        children = boxes.groupBy(parent.alias("_node")).agg(F.collect_list(F.struct(*boxes.columns)).alias("_boxes"))

        def reach(box):
            outside = {a: F.greatest(box[f"lo_{a}"] - F.col(a), F.col(a) - box[f"hi_{a}"], F.lit(0.0)) for a in axes}
            across = {a: F.greatest(F.abs(box[f"lo_{a}"] - F.col(a)), F.abs(box[f"hi_{a}"] - F.col(a))) for a in axes}
            near, far = (_sum(d[a] * d[a] for a in axes) for d in (outside, across))
            return F.struct(box["_child"].alias("node"), near.alias("near"), far.alias("far"))

        met = at.join(children, "_node", "left").withColumn("_reach", F.transform("_boxes", reach)).drop("_boxes", "_node")
        met = met.withColumn("_limit", F.least("_limit", F.array_min(F.transform("_reach", lambda r: r["far"]))))
        # A hair of slack keeps rounding from dropping an exact tie.
        kept = F.filter("_reach", lambda r: F.coalesce(r["near"] <= F.col("_limit") * (1 + 1e-9), F.lit(False)))
        at = met.withColumn("_node", F.explode_outer(F.transform(kept, lambda r: r["node"]))).drop("_reach")
    leaf = F.floor(F.col("_no") / FANOUT).cast("bigint")
    leaves = numbered.groupBy(leaf.alias("_node")).agg(F.collect_list(F.struct(*axes, "_s")).alias("_centres"))

    def found(c):
        gap = F.sqrt(_sum((F.col(a) - c[a]) * (F.col(a) - c[a]) for a in axes))
        return F.when(gap.isNotNull(), F.struct(gap.alias("d"), c["_s"]["seg_no"].alias("n"), c["_s"]["segment_id"].alias("s")))

    best = at.join(leaves, "_node", "left").withColumn("_w", F.array_min(F.transform("_centres", found)))
    # Below a single leaf nothing was unfolded, so there is nothing to gather.
    won = best if levels == 1 else best.groupBy("pos_id").agg(F.first("_row").alias("_row"), F.min("_w").alias("_w"))
    return won.select("_row.*", F.col("_w.s").alias("segment_id"), F.col("_w.d").alias("distance"))
