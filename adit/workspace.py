"""Shared-folder tables that cut lineage between the steps of a job.

Loops and range-partitioned indexes need their intermediate result pinned:
it must be computed once, survive a lost executor and carry real size
statistics for the next plan. All of that holds for a Parquet table in a
folder that driver and executors share: the one ``spark.checkpoint.dir`` names,
else one below the warehouse.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Root folder for this application's intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/adit-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, inside: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    return materialize_counted(df, name, inside=inside)[0]


def materialize_counted(
    df: DataFrame, name: str, counting: Column | None = None, inside: str | None = None, at: str | None = None
) -> tuple[DataFrame, int]:
    """As :func:`materialize`; also a row count taken while writing.

    ``counting`` restricts the count to rows it holds for; ``inside`` puts the
    table below the folder of a :func:`loop_folder`, ``at`` into a given folder.
    """
    number = F.count(F.lit(1)) if counting is None else F.count_if(counting)
    return materialize_measured(df, name, number, inside, at)


def materialize_measured(df: DataFrame, name: str, number: Column, inside: str | None = None, at: str | None = None) -> tuple[DataFrame, int]:
    """As :func:`materialize_counted`, with any aggregate of the rows."""
    spark = df.sparkSession
    path = at or (f"{inside}/{name}-{uuid.uuid4().hex}" if inside else new_path(spark, name))
    seen = Observation()
    df.observe(seen, number.alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def loop_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Folder for the tables of one loop, deleted with all of them at the end."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def task_count(spark: SparkSession) -> int:
    """Tasks of a shuffle; as many as there are cores where Spark chooses."""
    number = spark.conf.get("spark.sql.shuffle.partitions")
    return int(number) if number.isdigit() else spark.sparkContext.defaultParallelism


def one_row(df: DataFrame, *cols: Column) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery.

    Used instead of a join for global ranges, maxima and the like, so the
    row count of the other side never matters.
    """
    return df.agg(F.struct(*cols).alias("s")).scalar()
