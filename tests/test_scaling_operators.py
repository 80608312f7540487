"""Indexing, percentiles, nearest neighbours and rolling windows against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adit.operators import anomaly, nearest, sampling
from adit.operators.indexing import ordered_index
from adit.operators.quantiles import percentiles, value_counts
from adit.operators.running import running_totals


def test_index_is_dense_per_key_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(4000)]
    rows += [(None, 1, 5001), (None, 0, 5002)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(7)
    got = ordered_index(df, ["t", "id"], ["k"]).collect()
    for key in {r.k for r in got}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.t, r.id))
        assert [r.row_idx for r in mine] == list(range(len(mine)))
    total = sorted(ordered_index(df, ["t", "id"], start=1).collect(), key=lambda r: (r.t, r.id))
    assert [r.row_idx for r in total] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("ranges", ["1", "5", "40"])
def test_percentiles_match_interpolated_order_statistics(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    rng = random.Random(2)
    groups = {
        "one": [4.0],
        "pair": [1.0, 2.0],
        "ties": [3.0] * 50 + [7.0],
        "spread": [rng.gauss(0, 1e6) for _ in range(3000)],
        # All but two values crowd into one histogram cell.
        "crowded": [1e-9 * i for i in range(2000)] + [-1e9, 1e9],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    wanted = {"p0": 0, "p5": 5, "p50": 50, "p75": 75, "p99": 99, "p100": 100}
    for row in percentiles(value_counts(df, ["g"], "v"), ["g"], "v", wanted).collect():
        for name, p in wanted.items():
            assert np.isclose(row[name], np.percentile(groups[row.g], p), rtol=1e-12, atol=1e-15), (row.g, name)
    everything = [v for vs in groups.values() for v in vs]
    row = percentiles(value_counts(df, [], "v"), [], "v", {"p99": 99}).collect()
    assert len(row) == 1 and np.isclose(row[0].p99, np.percentile(everything, 99))


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert percentiles(value_counts(empty, [], "v"), [], "v", {"p": 50}).collect() == []


def test_nearest_matches_all_pairs(spark):
    rng = random.Random(3)
    centres = [(f"S{i}", i, rng.gauss(0, 1), rng.gauss(0, 1), 0.0) for i in range(300)]
    centres += [(f"S{i}", i, 50 + rng.random() * 1e-3, 50.0, 0.0) for i in range(300, 500)]
    centres.append(("S500", 500, *centres[0][2:]))
    places = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(-1, 1)) for i in range(400)]
    c = spark.createDataFrame(centres, "segment_id string, seg_no int, x double, y double, z double")
    p = spark.createDataFrame(places, "pos_id int, x double, y double, z double")
    got = {r.pos_id: r for r in nearest.nearest_segment(p, c).collect()}
    assert len(got) == len(places)
    for i, *at in places:
        d, n = min((sum((a - b) ** 2 for a, b in zip(at, q[2:])) ** 0.5, q[1]) for q in centres)
        assert abs(got[i].distance - d) < 1e-9 and got[i].segment_id == f"S{n}"


def test_rolling_blocks_do_not_show(spark):
    rng = random.Random(4)
    series = {"hot": [rng.random() for _ in range(500)], "cold": [rng.random() for _ in range(3)]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = anomaly.rolling(df, "k", "i", "v", 5, block=7).collect()
    assert len(got) == 503
    for r in got:
        span = series[r.k][max(0, r.i - 5) : r.i + 1]
        assert np.isclose(r.rolling_mean, np.mean(span)) and np.isclose(r.rolling_change, span[-1] - span[0])


def test_window_sample_takes_the_planned_records(spark):
    for total, target in ((1000, 250), (120, 119), (50, 80), (10, 1), (5, 0)):
        points = spark.range(total).select(F.col("id").alias("point_idx"))
        got = sampling.window_sample(points, total, target).orderBy("sample_idx").collect()
        take = min(target, total)
        expected = []
        if take:
            per = max(1, -(-take // min(100, take)))
            windows = -(-take // per)
            last = max(0, total - per)
            for w in range(windows):
                first = int(round(w * last / max(1, windows - 1)))
                expected += [i for i in range(first, first + per) if i < total]
        assert [r.point_idx for r in got] == expected[:take]
        assert [r.sample_idx for r in got] == list(range(len(got)))


def test_decimation(spark):
    rows = spark.range(100).select(F.col("id").alias("row_idx"))
    got = sampling.decimate(rows.withColumn("v", F.col("row_idx")), 4).orderBy("time_step").collect()
    assert [(r.time_step, r.v) for r in got] == [(0, 0), (1, 25), (2, 50), (3, 75)]
    few = sampling.decimate(rows.where("row_idx < 3"), 90).collect()
    assert sorted((r.time_step, r.step_rows) for r in few) == [(0, 1), (1, 1), (2, 1)]
    assert sampling.decimate(rows.limit(0), 90).count() == 0


def test_decimation_reaches_the_end_of_every_series(spark):
    sizes = {"a": 1000, "b": 995, "c": 7}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "worker_id string, row_idx long")
    got = sampling.decimate(rows.withColumn("v", F.col("row_idx")), 90).collect()
    for k, n in sizes.items():
        last = max(r.v for r in got if r.worker_id == k)
        assert last + got[0].step_rows >= n
    assert max(r.time_step for r in got) < 90

@pytest.mark.parametrize("seed", range(2))
def test_running_totals(spark, seed):
    """A hot key, null keys, null values, ties and negative values against plain addition."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(-50, 50), rng.choice([None, 0, 3, -7, 10**12]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v long, id int").repartition(9)
    got = running_totals(df, {"before": "v", "places": "id"}, ["t", "id"], ["k"]).collect()
    sums, want = defaultdict(lambda: [0, 0]), {}
    for k, t, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
        want[i] = tuple(sums[k])
        sums[k][0] += v or 0
        sums[k][1] += i
    assert {r.id: (r.before, r.places) for r in got} == want and len(got) == len(rows)
    total = {r.id: r.before for r in running_totals(df, {"before": "v"}, ["t", "id"]).collect()}
    so_far = 0
    for k, t, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
        assert total[i] == so_far
        so_far += v or 0
    # Rows alike in the order follow each other in some order.
    same = running_totals(df.select("k", F.lit(1).alias("t"), F.lit(2).cast("long").alias("v")), {"before": "v"}, ["t"], ["k"])
    for k, n in same.groupBy("k").count().collect():
        found = sorted(r.before for r in same.where(F.col("k").eqNullSafe(k)).collect())
        assert found == list(range(0, 2 * n, 2))


def test_running_totals_of_nothing(spark):
    assert running_totals(spark.createDataFrame([], "k string, v long"), {"before": "v"}, ["k"]).count() == 0
