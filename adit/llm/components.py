"""Connected components of large graphs, and spanning forests of small ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.workspace import loop_folder, materialize, materialize_counted


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect what the edges ``a[i]-b[i]`` connect.

    Each node but the smallest of its component is paired with that smallest
    one: at most one edge per node.
    """
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (columns a, b).

    Returns (node, component), one row per node of a component but its
    smallest. Alternates two steps until nothing changes: every node hands the
    smallest of its neighbours and itself to its larger neighbours, then to its
    smaller ones. Each round is a written table; the number of rounds follows
    the logarithm of the longest path. Minima are taken with partial
    aggregation, so a hub costs no single task; Spark splits its rows in the
    join. Loops, repeated edges and nulls are harmless; an empty table gives an
    empty one.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    with loop_folder(spark, "components") as folder:
        found = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links, n = materialize_counted(found, "links", inside=folder)
        before = None
        while n:
            both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = materialize(large.where("a <> b"), "large", inside=folder)
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            met = large.join(low, "a")
            small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
            links, n = materialize_counted(small, "links", inside=folder)
            # Done when every larger node has one link and no root hangs on another node.
            state = links.agg(F.count("*"), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        return materialize(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "components") if n else spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
