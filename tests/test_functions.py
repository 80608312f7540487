import random

import pytest
from pyspark.sql import functions as F

from adit.functions import scores, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_exact_round_agrees_with_correct_rounding(spark):
    rng = random.Random(7)
    values = [rng.uniform(-500, 500) for _ in range(3000)]
    values += [round(rng.uniform(0, 100), 3) + 0.0005 for _ in range(3000)]
    values += [n / 16 for n in range(-200, 200)] + [16.1195, 2.6755, 81.25, 0.35, 0.0, 1e12 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 6):
        rows = df.select("v", scores.exact_round(F.col("v"), digits).alias("r")).collect()
        assert [r.r for r in rows if abs(r.v) < 1e9] == [round(r.v, digits) for r in rows if abs(r.v) < 1e9]


@pytest.mark.parametrize(
    ("value", "lo", "hi", "expected"),
    [(5, 0, 10, 50.0), (20, 0, 10, 100.0), (-3, 0, 10, 0.0), (5, 5, 5, 0.0), (5, 9, 2, 0.0)],
)
def test_normalize(spark, value, lo, hi, expected):
    args = [F.lit(float(v)) for v in (value, lo, hi)]
    assert one(spark, scores.normalize(*args)) == expected
    assert one(spark, scores.normalize_inverse(*args)) == 100.0 - expected


def test_bands_use_the_unrounded_score(spark):
    df = spark.createDataFrame([(79.9999,), (80.0,), (60.0,), (30.0,), (29.9,)], "s double")
    got = [tuple(r) for r in df.select(scores.risk_level(F.col("s")), scores.gas_status(F.col("s"))).collect()]
    assert got == [
        ("HIGH", "high"), ("CRITICAL", "critical"), ("HIGH", "high"), ("MEDIUM", "medium"), ("LOW", "normal"),
    ]


def test_null_stays_null_when_clamped(spark):
    assert one(spark, scores.clamp(F.lit(None).cast("double"))) is None


def test_ratio_and_confidence(spark):
    assert one(spark, scores.ratio_score(F.lit(2.0), F.lit(0.0))) == 0.0
    assert one(spark, scores.ratio_score(F.lit(3.0), F.lit(2.0))) == 100.0
    assert one(spark, scores.confidence_factor(F.lit(45.0))) == 0.65
    assert one(spark, scores.confidence_factor(F.lit(90.0))) == 0.9
    assert one(spark, scores.reliability_score(F.lit(1.0), F.lit(0.0))) == 100.0
    assert one(spark, scores.reliability_score(F.lit(4.0), F.lit(4.0))) == 65.0


def test_edge_weight_counts_a_missing_length_as_one(spark):
    df = spark.createDataFrame([(None, None), (0.0, 10.0), (5.0, 10.0)], "l double, r double")
    assert [r[0] for r in df.select(scores.edge_weight(F.col("l"), F.col("r"))).collect()] == [1.0, 3.0, 7.0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("SEG_047", "S047"), ("S47", "S047"), ("47", "S047"), (" S1234 ", "S1234"), ("0007", "S007"),
        (" no digits ", "no digits"), ("12ab", "12ab"), ("", ""), (None, None),
        ("SEG_123456789012345678901234567890", "S123456789012345678901234567890"),
    ],
)
def test_segment_ids(spark, raw, expected):
    assert one(spark, text.canonical_segment_id(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), (".5", 0.5), ("", 0.0), (None, 0.0), ("x", 0.0), ("1d", 0.0), ("7f", 0.0)],
)
def test_float_cells(spark, raw, expected):
    assert one(spark, text.to_float(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("size", "expected"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (10761531736, "10.0 GB"), (2**52, "4096.0 TB")],
)
def test_human_size(spark, size, expected):
    assert one(spark, text.human_size(F.lit(size).cast("bigint"))) == expected


def test_records_and_reasons(spark):
    df = spark.createDataFrame([("SEG_001", "9", " High ")], "segment_id string, blocked_segment string, risk_level string")
    assert tuple(text.canonical_record(df).first()) == ("S001", "S009", "high")
    reasons = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None).cast("string"))
    assert one(spark, text.active_reasons(reasons)) == ["x"]
    assert one(spark, text.active_reasons(F.lit(None).cast("map<string,string>"))) == []
    shown = one(spark, text.reason_map(F.lit(54.743), F.lit(44.661), F.lit(81.25), F.lit(52.812), F.lit(100.0)))
    assert shown["gas"] == "Methane risk 81.2, confidence-adjusted 52.8"
    assert shown["worker"] == "worker is inside this segment"
