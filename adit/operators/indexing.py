"""Dense row numbers over inputs of any size.

A ``row_number`` without partitions sorts everything in one task, and one
per key sorts a hot key in one task. Here the rows are range-partitioned on
the whole sort key, so any key, hot or not, is spread over tasks. Only one
row per (range, key) takes part in the offset computation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.workspace import materialize


def ordered_index(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] | None = None,
    out: str = "row_idx",
    start: int = 0,
) -> DataFrame:
    """Append ``out``: the row's position in ``order_by``, per ``partition_by`` key."""
    keys = list(partition_by or [])
    sort = [*keys, *order_by]
    stamped = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", 33))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    return _number(materialize(stamped, "index"), ["_range"], keys, df.columns, out, start)


def scan_index(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Append ``out``: the row's position in its files, in (file, offset) order.

    ``df`` is a plain file scan, of the wanted columns alone. Its splits are
    ordered already, so nothing is sorted or shuffled. How files are split
    follows the cluster of the moment, so the scan is written once, each row
    with its split and its place in it, and numbered from what was written.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Rows of one split follow each other within one task, so their ids do too.
    placed = materialize(df.select(*df.columns, place.alias("_split"), F.monotonically_increasing_id().alias("_pos")), "scan")
    return _number(placed, ["_split"], [], df.columns, out, 0)


def _number(rows: DataFrame, piece: list[str], keys: list[str], columns: list[str], out: str, start: int) -> DataFrame:
    """Turn positions inside ordered pieces into positions inside keys."""
    runs = rows.groupBy(*piece, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    # One row per piece and key, no data.
    before = Window.partitionBy(*keys).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop(
        "_n", "_first"
    )
    left, right = rows.alias("l"), shifts.alias("r")
    same = reduce(
        lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*piece, *keys])
    )
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in columns],
        (F.col("l._pos") + F.col("r._shift") + start).cast("bigint").alias(out),
    )
