"""Exact interpolated percentiles that no single task has to hold.

``percentile`` keeps every distinct value of a group in one buffer. Here the
values are counted, dealt by ranges of (group, value) and written; the weights
of a group's ranges, one row each, give the rank at which each range starts.
Only ranges that hold a wanted rank are ranked value by value, each by itself. A
hot group, or the only one, is spread over ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.workspace import materialize


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, weight): the input of :func:`percentiles`."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))


def percentiles(counts: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row per key with a column per entry of ``wanted`` (name -> 0-100).

    Linear interpolation at ``(n - 1) * p / 100`` between order statistics.
    ``counts`` holds one row per key and distinct value with its ``weight``.
    Key columns must not be null.
    """
    base = counts.select(*keys, F.col(value).cast("double").alias("_v"), F.col("weight").alias("_w"))
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    dealt = materialize(base.repartitionByRange(*group, "_v").withColumn("_range", F.spark_partition_id()), "value-ranges")
    pieces = dealt.groupBy(*group, "_range").agg(F.sum("_w").alias("_cnt"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.withColumn("_before", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0))).withColumn(
        "_n", F.sum("_cnt").over(Window.partitionBy(*group))
    )
    spots = [F.floor((F.col("_n") - 1) * p / 100.0).cast("bigint") for p in wanted.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(s, F.least(s + 1, F.col("_n") - 1)) for s in spots])))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cnt")))
    holding = counted.withColumn("_ranks", ranks).withColumn("_ranks", inside).where(F.size("_ranks") > 0).drop("_cnt")
    upto = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        dealt.join(holding, [*group, "_range"])
        .withColumn("_at", F.col("_before") + F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_w")))
        .groupBy(*group)
        .agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at_rank"), F.first("_n").alias("_n"))
    )
    out = []
    for name, p in wanted.items():
        pos = (F.col("_n") - 1) * p / 100.0
        lo = F.floor(pos).cast("bigint")
        hi = F.least(lo + 1, F.col("_n") - 1)
        share = pos - lo
        out.append((F.col("_at_rank")[lo] * (1.0 - share) + F.col("_at_rank")[hi] * share).alias(name))
    return found.select(*keys, *out)
