"""Score arithmetic: clamping, normalising, weighting and banding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band thresholds, weights and floors of the risk model.
RISK_BANDS = ((80.0, "CRITICAL"), (60.0, "HIGH"), (30.0, "MEDIUM"))
RISK_BAND_FLOOR = "LOW"
GAS_BANDS = ((80.0, "critical"), (60.0, "high"), (30.0, "medium"))
GAS_BAND_FLOOR = "normal"
GEOMETRY_WEIGHTS = {
    "narrowness_score": 0.30,
    "low_ceiling_score": 0.25,
    "ceiling_roughness_score": 0.25,
    "geometry_change_score": 0.20,
}
GRAPH_WEIGHTS = {"graph_blocking_score": 0.60, "chokepoint_score": 0.25, "length_score": 0.15}
FUSION_WEIGHTS = {
    "lidar_geometry_risk": 0.35,
    "graph_risk_score": 0.25,
    "adjusted_methane": 0.25,
    "worker_exposure_score": 0.15,
}
ALTERNATIVE_FUSION_WEIGHTS = {
    "adjusted_methane": 0.30,
    "lidar_geometry_risk": 0.25,
    "worker_exposure_score": 0.25,
    "graph_risk_score": 0.20,
}
MIN_CONFIDENCE = 0.65
MIN_RELIABILITY = 45.0
DRIFT_PENALTY = 35.0
DRIFT_WARNING_BELOW = 70.0
RISK_COST_FACTOR = 0.20


def exact_round(x: Column, digits: int) -> Column:
    """Correctly rounded decimal rounding of the binary value, ties to even.

    ``round`` works on the shortest decimal text of a double, so 2.6755
    (stored just below) goes up. Here the product with the power of ten is
    taken together with its rounding error (Dekker's exact product), which
    decides apparent ties. Beyond 2^53 a product has no fraction left: there
    doubles lie no closer than the last digit and ``x`` is its own rounding.
    """
    scale = float(10**digits)
    spread = x * 134217729.0
    high = spread - (spread - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    rounded = (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale
    return F.when(F.abs(product) < 2.0**53, rounded).otherwise(x)


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def normalize(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling to 0-100; a degenerate range gives 0."""
    return F.when(hi <= lo, F.lit(0.0)).otherwise(clamp((x - lo) / (hi - lo) * 100.0))


def normalize_inverse(x: Column, lo: Column, hi: Column) -> Column:
    return F.lit(100.0) - normalize(x, lo, hi)


def weighted_sum(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in weights.items()))


def banded(score: Column, bands, floor: str) -> Column:
    """First band whose lower bound the unrounded score reaches."""
    chain = F
    for bound, label in bands:
        chain = chain.when(score >= bound, F.lit(label))
    return chain.otherwise(F.lit(floor))


def risk_level(score: Column) -> Column:
    return banded(score, RISK_BANDS, RISK_BAND_FLOOR)


def gas_status(score: Column) -> Column:
    return banded(score, GAS_BANDS, GAS_BAND_FLOOR)


def ratio_score(x: Column, normaliser: Column) -> Column:
    """Share of a robust maximum, as a 0-100 score."""
    return F.when(normaliser == 0, F.lit(0.0)).otherwise(clamp(x / normaliser * 100.0))


def confidence_factor(reliability: Column) -> Column:
    return F.greatest(F.lit(MIN_CONFIDENCE), reliability / 100.0)


def reliability_score(stdev: Column, max_stdev: Column) -> Column:
    ratio = F.when(max_stdev == 0, F.lit(0.0)).otherwise(stdev / max_stdev)
    return F.greatest(F.lit(MIN_RELIABILITY), F.lit(100.0) - ratio * DRIFT_PENALTY)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def distance(a: Column, b: Column, axes=("x", "y", "z")) -> Column:
    """Euclidean distance between two structs over the named axes."""
    return F.sqrt(reduce(lambda p, q: p + q, ((a[k] - b[k]) * (a[k] - b[k]) for k in axes)))


def edge_weight(length: Column, risk: Column) -> Column:
    """Travel cost of a segment: a missing or zero length counts as 1."""
    base = F.when(length.isNull() | (length == 0), F.lit(1.0)).otherwise(length)
    return base + F.coalesce(risk, F.lit(0.0)) * RISK_COST_FACTOR
