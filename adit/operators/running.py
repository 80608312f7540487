"""Running totals over inputs of any size and skew.

A running window over a hot key would run in one task. Here rows are
range-partitioned on the whole sort key, each range adds up its own rows, and
only one row per (range, key) takes part in the totals of the ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.workspace import materialize


def running_totals(
    df: DataFrame,
    totals: dict[str, str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    inside: str | None = None,
) -> DataFrame:
    """Append, for each ``out: column`` of ``totals``, the sum of ``column`` over all rows before.

    Rows come in the order of ``order_by`` per ``partition_by`` key; null keys
    form a group of their own, null values count as 0. Rows equal in the whole
    order follow each other in any order. ``inside`` is a folder for the table
    that pins the ranges.
    """
    keys = list(partition_by or [])
    sort = [*keys, *order_by]
    stamped = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", 33))
    )
    rows = materialize(stamped, "running", inside=inside)
    own = Window.partitionBy("_range", *keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in totals.items()])
    sums = sums.select(
        "_range", *keys, *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_shift_{o}") for o in totals]
    )
    inner = rows.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_own_{o}") for o, c in totals.items()])
    left, right = inner.alias("l"), sums.alias("r")
    same = reduce(
        lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ["_range", *keys])
    )
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l._own_{o}") + F.col(f"r._shift_{o}")).alias(o) for o in totals],
    )
