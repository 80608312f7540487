"""Text, JSON and Parquet sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit import schemas
from adit.operators.indexing import ordered_index, scan_index
from adit.sources import lines

CELLS = {"escape": '"'}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV by column name, all cells as text; a byte-order mark is ignored.

    Nothing is inferred: only the header line is read ahead. Quotes inside a
    quoted cell are doubled.
    """
    return spark.read.options(header=True, **CELLS).csv(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_indexed_csv(spark, path, schemas.EDGE_LIST, index="row_no")


def read_indexed_csv(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] | None = None,
    max_rows: int | None = None,
    index: str = "row_idx",
    range_bytes: int = lines.RANGE_BYTES,
) -> DataFrame:
    """A CSV with its rows numbered in file order; ``max_rows`` keeps only the first ones.

    All cells are text, an empty cell is null, a row that is too short is filled
    up with nulls. Numbers come from byte ranges planned once (:mod:`lines`);
    where only Spark can open the path, from one pinned scan.
    """
    if not lines.opens(path):
        rows = read_csv(spark, path)
        rows = scan_index(rows if columns is None else rows.select([c for c in columns if c in rows.columns]), index)
        names = [c for c in rows.columns if c != index]
        rows = rows if max_rows is None else rows.where(F.col(index) < max_rows)
    else:
        plan = lines.count_lines(spark, lines.plan_lines(path, range_bytes=range_bytes))
        names = lines.header_names(plan)
        schema = ", ".join(f"{quoted(c)} string" for c in names)
        numbered = lines.load(spark, plan, max_rows).withColumnRenamed("row_idx", index)
        rows = numbered.select(index, F.from_csv("line", schema, CELLS).alias("_cells")).select(index, "_cells.*") if names else numbered.select(index)
    if columns is None:
        return rows.select(*[F.col(quoted(c)) for c in names], index)
    missing = F.lit(None).cast("string")
    return rows.select(index, *[F.col(quoted(c)) if c in names else missing.alias(c) for c in columns])


def read_drift_lines(
    spark: SparkSession, path: str, max_lines: int | None = None, pattern: str = "batch*.dat"
) -> DataFrame:
    """(file_name, line) of the batches in a folder, blank lines left out.

    A batch is a ``.dat`` file, or a folder of that name with text parts.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/=]+\.dat)(/|$)", 1)
    read = spark.read.text(f"{path}/{pattern}")
    if max_lines is None:
        named = read.select(name.alias("file_name"), F.col("value").alias("line"))
    else:
        placed = read.select(
            name.alias("file_name"),
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        numbered = ordered_index(placed, ["_file", "_block", "_row"], ["file_name"], out="_no")
        named = numbered.where(F.col("_no") < max_lines).select("file_name", "line")
    return named.where(F.trim("line") != "")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, path: str, schema: str, default_empty: bool = False) -> DataFrame:
    """A JSON document (array of records); optionally empty when it is absent.

    One document cannot be split; tables meant to grow go in as JSON lines
    (:func:`read_json_lines`) or Parquet.
    """
    if not path_exists(spark, path):
        if default_empty:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(f"data file is missing: {path}")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_points(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored points; a limit is pushed down as a filter on the point number."""
    points = spark.read.schema(schemas.STORED_POINTS).parquet(path)
    return points if limit is None else points.where(F.col("point_idx") < limit)


def write_points(points: DataFrame, path: str) -> None:
    """Point sample with single-precision coordinates."""
    axes = [F.col(c).cast("float").alias(c) for c in ("x", "y", "z")]
    points.select("point_idx", *axes).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, **CELLS).csv(path)
