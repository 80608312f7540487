"""Tunnel-shaped inputs derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.operators.indexing import ordered_index
from adit.plans.pipeline import Inputs, Pipeline, Settings

SETTINGS = Settings(
    exit_node="0",
    methane_columns=("m1", "m2", "m3", "m4", "m5"),
)
GAS_EVENTS = {"m1": "click", "m2": "view", "m3": "error", "m4": "signup", "m5": "purchase"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over the suppliers plus a cross link from every fifth one."""
    supplier = table(spark, sf_dir, "supplier")
    key, size = F.col("s_suppkey"), F.abs("s_acctbal")
    notes = F.when(F.col("s_nationkey") % 10 == 0, F.lit("chokepoint")).otherwise(F.lit(""))
    tree = supplier.where(key > 0).select(
        F.lit(0).alias("kind"), key.alias("a"), F.floor(key / 2).alias("b"), (size / 100).alias("len"), notes.alias("notes")
    )
    links = supplier.where((key % 5 == 0) & (key >= 4)).select(
        F.lit(1).alias("kind"), key.alias("a"), F.floor(key / 4).alias("b"), (size / 50).alias("len"), F.lit("").alias("notes")
    )
    rows = ordered_index(tree.unionByName(links), ["kind", "a"], out="row_no")
    return rows.select(
        "row_no",
        F.col("a").cast("string").alias("FROM"),
        F.col("b").cast("string").alias("TO"),
        F.col("len").cast("string").alias("LENGTH"),
        F.col("notes").alias("NOTES"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per line item; no point numbers, the slices do not need them."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 100).alias("x"),
        F.col("l_quantity").alias("y"),
        (F.col("l_discount") * 100 + F.col("l_tax") * 100).alias("z"),
    )


def numbered_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per event, numbered by the event's own dense id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_idx"),
        F.col("value").alias("x"),
        (F.col("user_id") * 0.25).alias("y"),
        F.length("event_type").cast("double").alias("z"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props")
    rows = ordered_index(events, ["ts", "event_id"], ["user_id"])
    mark = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return rows.select(
        F.col("user_id").cast("string").alias("worker_id"),
        "row_idx",
        F.floor(F.col("value") / 5).cast("double").alias("pose_x"),
        F.floor(mark / 50).cast("double").alias("pose_y"),
        F.lit(0.0).alias("pose_z"),
        (F.col("value") / 15).alias("acc_x"),
        F.lit(0.0).alias("acc_y"),
        F.lit(1.0).alias("acc_z"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour with a methane column per event type."""
    hour = F.date_trunc("hour", "ts")
    hourly = table(spark, sf_dir, "events").groupBy(hour.alias("h")).agg(
        *[F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(m) for m, kind in GAS_EVENTS.items()]
    )
    return ordered_index(hourly, ["h"]).drop("h")


def drift_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of one batch per order priority, every 97th malformed."""
    orders = table(spark, sf_dir, "orders")
    batch = ordered_index(orders.select("o_orderpriority").distinct(), ["o_orderpriority"], out="p", start=1)
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    line = F.when(F.col("o_orderkey") % 97 == 0, F.lit("malformed 1:0.5")).otherwise(
        F.concat("o_orderstatus", F.lit(";"), price, F.lit(" 1:0.5 2:0.7"))
    )
    return orders.join(batch, "o_orderpriority").select(
        F.concat(F.lit("batch"), F.col("p").cast("string"), F.lit(".dat")).alias("file_name"), line.alias("line")
    )


def segment_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = key.cast("string")
    raw = (
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 5 == 0, F.lit(" no digits "))
        .when(key % 3 == 0, F.concat(F.lit("SEG_"), text))
        .when(key % 2 == 0, F.concat(F.lit(" S"), text, F.lit(" ")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "part").select(key.alias("id"), raw.alias("raw_id"))


class LazyInputs(Inputs):
    """Inputs built on first use, so a question pays only for what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        makers = {
            "edges": edge_rows,
            "points": cloud,
            "tracks": tracks,
            "readings": readings,
            "drift_lines": drift_lines,
        }
        object.__setattr__(self, "_make", {k: (lambda f=f: f(spark, sf_dir)) for k, f in makers.items()})

    def __getattr__(self, name):
        if name not in self._make:
            raise AttributeError(name)
        made = self._make[name]()
        object.__setattr__(self, name, made)
        return made


def pipeline(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> Pipeline:
    return Pipeline(LazyInputs(spark, sf_dir), settings)
