"""Time-step selection shared by every view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.workspace import one_row, task_count

STEP_BLOCK = 64


def parse_time_step(raw: str | None, default: int | None = 0) -> int | None:
    """``None`` or empty: the default; ``all``: no filter; otherwise a number."""
    if raw is None or raw == "":
        return default
    return None if raw.lower() == "all" else int(raw)


def at_time_step(df: DataFrame, time_step: int | None = 0) -> DataFrame:
    """Rows of one step; if it does not occur, of the smallest step that does."""
    if time_step is None or "time_step" not in df.columns:
        return df
    found = one_row(
        df,
        F.max(F.col("time_step") == time_step).alias("hit"),
        F.min("time_step").alias("first"),
    )
    chosen = F.when(found["hit"], F.lit(time_step)).otherwise(found["first"])
    return df.where(F.col("time_step") == chosen)


def over_steps(df: DataFrame, last_step: Column, *keys: str) -> DataFrame:
    """Every row once per step 0..last_step.

    A small table would multiply inside the one task that reads it, so blocks
    of steps are dealt to a fixed number of tasks before they are filled in.
    """
    tasks = task_count(df.sparkSession)
    blocks = (
        df.withColumn("_last", last_step)
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_last"), F.lit(STEP_BLOCK))))
        .repartition(tasks, *keys, "_from")
    )
    to = F.least(F.col("_from") + STEP_BLOCK - 1, F.col("_last"))
    return blocks.withColumn("time_step", F.explode(F.sequence("_from", to))).drop("_from", "_last")


def max_time_step(*tables: DataFrame):
    """Highest step over several tables as a scalar column, 0 without rows."""
    steps = tables[0].select("time_step")
    for t in tables[1:]:
        steps = steps.unionByName(t.select("time_step"))
    return F.coalesce(one_row(steps, F.max("time_step").alias("m"))["m"], F.lit(0))
