"""Identifier, number-text and message expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.scores import exact_round

# Columns that carry a segment id.
SEGMENT_ID_COLUMNS = (
    "segment_id",
    "mapped_segment_id",
    "current_segment",
    "worker_segment",
    "blocked_segment",
)
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def to_float(c: Column, default: float | None = 0.0) -> Column:
    """Text to double; anything that is not a plain number gives ``default``."""
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(default).cast("double"))


def canonical_segment_id(c: Column) -> Column:
    """The digits that end an id, without leading zeros, as ``S`` and three digits or more.

    ``gallery-5`` gives ``S005`` and ``X0012345`` gives ``S12345``. An id that
    does not end in a digit is only stripped. The digits stay text, so their
    number is not limited.
    """
    text = strip(c)
    digits = F.regexp_extract(text, r"(\d+)$", 1)
    number = F.regexp_replace(digits, r"^0+(?=\d)", "")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(digits == "", text).otherwise(F.concat(F.lit("S"), padded))


def canonical_risk_level(c: Column) -> Column:
    return F.lower(strip(c))


def canonical_record(df: DataFrame) -> DataFrame:
    """Normalise every segment-id column present, and the risk level."""
    changes = {c: canonical_segment_id(F.col(c)) for c in SEGMENT_ID_COLUMNS if c in df.columns}
    if "risk_level" in df.columns:
        changes["risk_level"] = canonical_risk_level(F.col("risk_level"))
    return df.withColumns(changes) if changes else df


def human_size(size: Column) -> Column:
    """Byte count with a unit; whole bytes, otherwise one decimal."""
    value = size.cast("double")
    text = F
    for power, unit in enumerate(SIZE_UNITS):
        scaled = value / float(1024**power)
        shown = (
            F.concat(F.floor(value).cast("string"), F.lit(" B"))
            if power == 0
            else F.format_string(f"%.1f {unit}", exact_round(scaled, 1))
        )
        text = text.otherwise(shown) if unit == SIZE_UNITS[-1] else text.when(scaled < 1024, shown)
    return text


def numbered(prefix: str, width: int, number: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number.cast("bigint"))


def reasons(lidar: Column, graph: Column, methane: Column, adjusted: Column, exposure: Column) -> dict[str, Column]:
    """Readable reasons behind a fused score, by name."""
    lidar, graph, methane, adjusted = (exact_round(c, 1) for c in (lidar, graph, methane, adjusted))
    # Message texts.
    return {
        "lidar": F.format_string("LiDAR geometry risk %.1f", lidar),
        "graph": F.format_string("Graph blocking risk %.1f", graph),
        "gas": F.format_string("Methane risk %.1f, confidence-adjusted %.1f", methane, adjusted),
        "worker": F.when(exposure > 0, F.lit("worker is inside this segment")).otherwise(F.lit("no active worker exposure")),
    }


def as_map(texts: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, text in texts.items() for x in (F.lit(name), text)])


def reason_map(lidar: Column, graph: Column, methane: Column, adjusted: Column, exposure: Column) -> Column:
    """Four readable reasons behind a fused score."""
    return as_map(reasons(lidar, graph, methane, adjusted, exposure))


def active_reasons(reasons: Column) -> Column:
    """Non-empty texts of a reason map; none for a missing map."""
    texts = F.filter(F.map_values(reasons), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(texts, F.array().cast("array<string>"))
