"""Gas anomaly indicators, stillness and risk trend.

The design documents name these without constants, so thresholds and weights
are parameters with defaults of our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.scores import clamp

# Rows of one key that a window task takes before the key is split.
BLOCK_ROWS = 65536


def threshold_flag(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    return rows.withColumn("above_threshold", F.col(value) >= threshold)


def zscore(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Deviation from the key's mean in sample deviations; 0 without spread.

    Moments are aggregated and joined back, so a hot key is never one task.
    """
    moments = rows.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev"))
    score = F.when(F.col("_dev") > 0, (F.col(value) - F.col("_mean")) / F.col("_dev")).otherwise(F.lit(0.0))
    return rows.join(moments, key).withColumn("zscore", score).drop("_mean", "_dev")


def rolling(rows: DataFrame, key: str, index: str, value: str, back: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean over the current and ``back`` earlier rows, and the change across them.

    ``index`` numbers a key's rows densely from 0. Keys are cut into blocks,
    each preceded by the ``back`` rows it needs, so a long series is spread
    over tasks.
    """
    block = max(block, back)
    home = F.floor(F.col(index) / block)
    spill = F.col(index) % block >= block - back
    blocks = F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    split = rows.withColumn("_home", home).withColumn("_block", blocks)
    near = Window.partitionBy(key, "_block").orderBy(index)
    span = near.rowsBetween(-back, 0)
    return (
        split.withColumn("rolling_mean", F.avg(value).over(span))
        .withColumn("rolling_change", F.col(value) - F.first(value).over(span))
        .where(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )


def anomaly_score(
    flagged,
    z,
    change,
    change_scale: float,
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
    z_scale: float = 3.0,
):
    """Threshold, deviation and change combined into 0-1."""
    w_flag, w_z, w_change = weights
    return clamp(
        w_flag * F.when(flagged, F.lit(1.0)).otherwise(F.lit(0.0))
        + w_z * clamp(F.abs(z) / z_scale, 0.0, 1.0)
        + w_change * clamp(F.abs(change) / change_scale, 0.0, 1.0),
        0.0,
        1.0,
    )


def gas_anomalies(
    gas: DataFrame, threshold: float, back: int, change_scale: float, index: str = "time_step"
) -> DataFrame:
    """All indicators on sensor readings (sensor_id, methane_value)."""
    flagged = threshold_flag(gas, "methane_value", threshold)
    scored = rolling(zscore(flagged, "sensor_id", "methane_value"), "sensor_id", index, "methane_value", back)
    return scored.withColumn(
        "anomaly_score",
        anomaly_score(F.col("above_threshold"), F.col("zscore"), F.col("rolling_change"), change_scale),
    )


def still_periods(workers: DataFrame, min_steps: int) -> DataFrame:
    """Runs of at least ``min_steps`` consecutive still steps per worker.

    Works on the sampled timeline, which bounds the rows of a worker.
    """
    history = Window.partitionBy("worker_id").orderBy("time_step")
    still = workers.where(F.col("motion_status") == "still")
    runs = still.withColumn("_run", F.col("time_step") - F.row_number().over(history))
    return (
        runs.groupBy("worker_id", "_run")
        .agg(
            F.min("time_step").alias("from_step"),
            F.max("time_step").alias("to_step"),
            F.count(F.lit(1)).alias("steps"),
        )
        .where(F.col("steps") >= min_steps)
        .drop("_run")
    )


def risk_trend(fused: DataFrame) -> DataFrame:
    """Least-squares slope of the fused risk over the steps, per segment."""
    return fused.groupBy("segment_id").agg(
        F.coalesce(F.regr_slope("final_segment_risk", "time_step"), F.lit(0.0)).alias("risk_slope"),
        F.count(F.lit(1)).alias("steps"),
    )
