"""Methane readings: row mean, robust normaliser and the sensor timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.functions.scores import exact_round, gas_status, ratio_score
from adit.functions.text import to_float
from adit.operators.quantiles import percentiles, value_counts
from adit.operators.sampling import decimate
from adit.workspace import one_row

# Methane columns of the coal-mine data set.
METHANE_COLUMNS = ("MM252", "MM261", "MM262", "MM263", "MM264", "MM256", "MM211")


def row_mean(readings: DataFrame, columns=METHANE_COLUMNS) -> DataFrame:
    """(row_idx, methane): mean over the columns present; bad cells count as 0."""
    present = [c for c in columns if c in readings.columns]
    total = reduce(lambda a, b: a + b, (to_float(F.col(c)) for c in present)) if present else F.lit(0.0)
    return readings.select("row_idx", (total / max(1, len(present))).alias("methane"))


def normaliser(means: DataFrame) -> DataFrame:
    """One row (p99, max_value, normaliser) over every row scanned.

    A zero p99 falls back to the maximum, no rows to 1.
    """
    p99 = percentiles(value_counts(means, [], "methane"), [], "methane", {"p99": 99}).select("p99").scalar()
    return means.agg(F.max("methane").alias("max_value")).select(
        p99.alias("p99"),
        "max_value",
        F.coalesce(F.nullif(p99, F.lit(0.0)), F.col("max_value"), F.lit(1.0)).alias("normaliser"),
    )


def gas_timeline(means: DataFrame, sensors: DataFrame, steps: int) -> DataFrame:
    """Sampled readings, one row per step and sensor.

    ``sensors`` is the result of the placement top-k, so the array spliced
    into every sampled row holds that many entries.
    """
    norm = normaliser(means).select("normaliser").scalar()
    sensor = F.struct("sensor_id", "segment_id", "placement_reason")
    every = one_row(sensors, F.sort_array(F.collect_list(sensor)).alias("a"))
    rows = (
        decimate(means, steps)
        .withColumn("_risk", ratio_score(F.col("methane"), norm))
        .withColumn("_sensor", F.explode(every["a"]))
    )
    return rows.select(
        "time_step",
        "_sensor.sensor_id",
        "_sensor.segment_id",
        exact_round(F.col("methane"), 6).alias("methane_value"),
        exact_round(F.col("_risk"), 3).alias("methane_risk_score"),
        gas_status(F.col("_risk")).alias("status"),
        "_sensor.placement_reason",
    )
