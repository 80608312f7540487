"""Sensor reliability from drift batches (lines ``class;concentration feat:val ...``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.functions.scores import DRIFT_WARNING_BELOW, exact_round, reliability_score
from adit.functions.text import numbered, strip, to_float
from adit.operators.indexing import ordered_index
from adit.workspace import one_row

SENSOR_CYCLE = 3


def parse_drift_lines(lines: DataFrame) -> DataFrame:
    """(file_name, class, concentration); lines without ``;`` in the first token drop out."""
    first = F.split(strip(F.col("line")), r"\s+", 2)[0]
    cut = F.instr(first, ";")
    number = F.substring(first, cut + 1, F.length(first))
    return (
        lines.select("file_name", first.alias("_first"), cut.alias("_cut"), to_float(number, None).alias("_value"))
        .where(F.col("_cut") > 0)
        .select(
            "file_name",
            F.substring("_first", F.lit(1), F.col("_cut") - 1).alias("class"),
            F.col("_value").alias("concentration"),
        )
    )


def drift_batches(parsed: DataFrame) -> DataFrame:
    """Per file: parsable values, class counts, mean and sample deviation.

    Classes are summarised first, so a large file is spread over tasks; the
    class summaries are then pooled around the file mean.
    """
    by_class = parsed.groupBy("file_name", "class").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("concentration").alias("n"),
        F.avg("concentration").alias("mean"),
        F.var_pop("concentration").alias("var"),
    )
    n, mean = F.col("n"), F.coalesce("mean", F.lit(0.0))
    files = by_class.groupBy("file_name").agg(
        F.sum("n").alias("rows_scanned"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "rows")))).alias("class_counts"),
        F.sum(n * mean).alias("_sum"),
        F.collect_list(
            F.struct("n", mean.alias("mean"), F.coalesce("var", F.lit(0.0)).alias("var"))
        ).alias("_parts"),
    )
    centre = F.when(F.col("rows_scanned") > 0, F.col("_sum") / F.col("rows_scanned")).otherwise(F.lit(0.0))
    squares = F.aggregate(
        "_parts",
        F.lit(0.0),
        lambda acc, p: acc
        + p["n"] * (p["var"] + (p["mean"] - F.col("concentration_mean")) * (p["mean"] - F.col("concentration_mean"))),
    )
    return (
        files.withColumn("concentration_mean", centre)
        .withColumn(
            "concentration_stdev",
            F.when(F.col("rows_scanned") > 1, F.sqrt(squares / (F.col("rows_scanned") - 1))).otherwise(F.lit(0.0)),
        )
        .drop("_sum", "_parts")
    )


def sensor_reliability(batches: DataFrame) -> DataFrame:
    """Batches, in file-name order, dealt to three sensors and scored by spread."""
    highest = F.coalesce(one_row(batches, F.max("concentration_stdev").alias("s"))["s"], F.lit(1.0))
    score = F.col("_score")
    return (
        ordered_index(batches, ["file_name"], out="_idx")
        .withColumn("_score", reliability_score(F.col("concentration_stdev"), highest))
        .select(
            numbered("GAS_SENSOR_", 2, F.col("_idx") % SENSOR_CYCLE + 1).alias("sensor_id"),
            F.col("file_name").alias("source_batch"),
            exact_round(score, 3).alias("sensor_reliability_score"),
            (score < DRIFT_WARNING_BELOW).alias("drift_warning"),
            exact_round(F.lit(100.0) - score, 3).alias("sensor_anomaly_score"),
            # Message texts.
            F.when(score >= DRIFT_WARNING_BELOW, F.lit("gas reading is considered reliable"))
            .otherwise(F.lit("drift/anomaly warning should reduce confidence"))
            .alias("interpretation"),
            F.struct(
                F.col("file_name").alias("file"),
                "rows_scanned",
                "class_counts",
                "concentration_mean",
                "concentration_stdev",
            ).alias("batch_summary"),
        )
    )
