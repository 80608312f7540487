import struct

import pytest
from pyspark.sql import functions as F

from adit import schemas
from adit.operators import segments
from adit.operators.sampling import window_ranges
from adit.plans import jobs
from adit.sources import files, las, published, tables


def test_edge_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_bytes("﻿TO,FROM,LENGTH,NOTES,EXTRA\n 1 ,3,2.5, A ChokePoint ,x\n2,1,,,y\n".encode())
    got = segments.build_segments(tables.read_edges(spark, str(path))).orderBy("seg_no").collect()
    assert [tuple(r) for r in got] == [
        (1, "SEG_001", "3", "1", 2.5, "A ChokePoint", True), (2, "SEG_002", "1", "2", 0.0, "", False),
    ]


def test_large_csv_keeps_file_order_over_splits(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("pose_x,other\n" + "".join(f"{i},{'z' * 50}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        rows = tables.read_indexed_csv(spark, str(path), ("pose_x", "missing"))
        assert rows.where(F.col("row_idx") != F.col("pose_x").cast("bigint")).count() == 0
        assert rows.count() == 20_000 and rows.where("missing is not null").count() == 0
        assert tables.read_indexed_csv(spark, str(path), max_rows=7).count() == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_drift_folder(spark, tmp_path):
    (tmp_path / "batch2.dat").write_text("1;2.0 1:3\n\n  \nnoise\n2;3.0 1:1\n")
    (tmp_path / "batch10.dat").write_text("".join(f"1;{i} 1:3\n" for i in range(5)))
    (tmp_path / "readme.txt").write_text("1;9\n")
    got = tables.read_drift_lines(spark, str(tmp_path))
    assert {(r.file_name, r["count"]) for r in got.groupBy("file_name").count().collect()} == {("batch2.dat", 3), ("batch10.dat", 5)}
    capped = tables.read_drift_lines(spark, str(tmp_path), max_lines=2).where("file_name = 'batch10.dat'")
    assert sorted(r.line for r in capped.collect()) == ["1;0 1:3", "1;1 1:3"]


def test_json_document_and_default(spark, tmp_path):
    path = tmp_path / "gas.json"
    path.write_text('[{"time_step": 1, "sensor_id": "A"},\n {"time_step": 2}]')
    assert tables.read_json(spark, str(path), schemas.GAS).count() == 2
    gone = str(tmp_path / "gone.json")
    assert tables.read_json(spark, gone, schemas.GAS, default_empty=True).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_json(spark, gone, schemas.GAS)


STEPS = "point_idx bigint, x double, y double, z double, time_step bigint"


def test_points_round_trip_and_publish(spark, tmp_path):
    points = spark.range(50).select(F.col("id").alias("point_idx"), *[(F.col("id") * 0.5).alias(c) for c in "xyz"])
    tables.write_points(points, str(tmp_path / "p"))
    assert tables.read_points(spark, str(tmp_path / "p"), limit=9).count() == 9
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    published.publish(points.withColumn("time_step", F.col("point_idx") % 3), a, b, partition_by="time_step")
    for zone in (a, b):
        assert published.read_published(spark, zone, STEPS).where("time_step = 1").count() == 17
    tables.write_csv(points, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).columns == ["point_idx", "x", "y", "z"]


def make_las(path, count, length=34, offset=400, first=0):
    header = bytearray(offset)
    header[:4] = b"LASF"
    header[24:26] = bytes((1, 2))
    struct.pack_into("<HI", header, 94, 227, offset)
    struct.pack_into("<BHI", header, 104, 0x80 | 3, length, count)
    struct.pack_into("<3d", header, 131, 0.01, 0.01, 0.5)
    struct.pack_into("<3d", header, 155, 100.0, 0.0, -1.0)
    struct.pack_into("<6d", header, 179, 9.0, 1.0, 8.0, 2.0, 7.0, 3.0)
    body = b"".join(struct.pack("<iii", i, -i, 2 * i) + b"\xff" * (length - 12) for i in range(first, first + count))
    path.write_bytes(bytes(header) + body)


def test_las_header_and_points(spark, tmp_path):
    path = tmp_path / "a.las"
    make_las(path, 1000)
    header = las.read_header(str(path))
    assert header["version"] == "1.2" and header["point_format"] == 3 and header["mins"] == [1.0, 2.0, 3.0]
    points = las.read_las(spark, str(path), partition_records=300)
    assert points.rdd.getNumPartitions() == 4
    got = points.orderBy("point_idx").collect()
    assert [r.point_idx for r in got] == list(range(1000))
    assert got[999].x == 999 * 0.01 + 100.0 and got[999].y == -999 * 0.01 and got[999].z == 1998 * 0.5 - 1.0


def test_las_ranges_stride_and_folder(spark, tmp_path):
    make_las(tmp_path / "a.las", 700)
    make_las(tmp_path / "b.las", 300, first=700)
    folder = str(tmp_path)
    assert las.point_total(folder) == 1000
    assert las.read_las(spark, folder, max_points=750).count() == 750
    every = las.read_las(spark, folder, stride=100).orderBy("point_idx").collect()
    assert [r.point_idx for r in every] == list(range(0, 1000, 100))
    ranges = window_ranges(spark, 1000, 250)
    sample = las.read_las(spark, folder, ranges=ranges).collect()
    assert sorted(r.point_idx for r in sample) == [i for a, b in ranges for i in range(a, b)]
    assert all(abs(r.x - (r.point_idx * 0.01 + 100)) < 1e-9 for r in sample)


def test_las_without_points(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    make_las(tmp_path / "zero.las", 0)
    for path in ("empty", "zero.las"):
        assert las.read_las(spark, str(tmp_path / path)).count() == 0
    make_las(tmp_path / "a.las", 5)
    assert las.read_las(spark, str(tmp_path / "a.las"), max_points=0).count() == 0
    assert las.read_las(spark, str(tmp_path / "a.las"), ranges=[]).count() == 0


def test_las_long_count(spark, tmp_path):
    path = tmp_path / "new.las"
    make_las(path, 12)
    raw = bytearray(path.read_bytes())
    raw[24:26] = bytes((1, 4))
    struct.pack_into("<HI", raw, 94, 375, 400)
    struct.pack_into("<I", raw, 107, 0)
    struct.pack_into("<Q", raw, 247, 12)
    path.write_bytes(bytes(raw))
    assert las.point_total(str(path)) == 12 and las.read_las(spark, str(path)).count() == 12


def test_las_truncated_file_is_an_error(spark, tmp_path):
    path = tmp_path / "cut.las"
    make_las(path, 10)
    path.write_bytes(path.read_bytes()[: 400 + 4 * 34])
    with pytest.raises(Exception, match="before record 4 of 10"):
        las.read_las(spark, str(path)).collect()


def test_las_stride_far_and_near(spark, tmp_path, monkeypatch):
    make_las(tmp_path / "a.las", 700)
    make_las(tmp_path / "b.las", 300, first=700)
    for stride, part in ((7, 50), (3, 64), (2500 // 34, 90)):
        for skip in (1 << 16, 10):
            monkeypatch.setattr(las, "SKIP_BYTES", skip)
            got = las.read_las(spark, str(tmp_path), stride=stride, partition_records=part).orderBy("point_idx").collect()
            assert [r.point_idx for r in got] == list(range(0, 1000, stride))
            assert all(abs(r.x - (r.point_idx * 0.01 + 100)) < 1e-9 for r in got)


def test_las_writer_starts_new_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(las, "FILE_RECORDS", 300)
    points = spark.range(1000).select(F.col("id").alias("point_idx"), *[(F.col("id") * 0.25).alias(c) for c in "xyz"]).coalesce(1)
    out = str(tmp_path / "out")
    las.write_las(points, out)
    assert sorted(las.read_header(str(p))["point_count"] for p in (tmp_path / "out").iterdir()) == [100, 300, 300, 300]
    back = las.read_las(spark, out).orderBy("point_idx").collect()
    assert [round(r.x, 2) for r in back] == [i * 0.25 for i in range(1000)]


def test_listing_keeps_hidden_names_and_skips_missing_roots(spark, tmp_path):
    for name in (".hidden", "_private.csv", "plain.csv"):
        (tmp_path / name).write_text("x")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "x.csv").write_text("x")
    got = files.list_files(spark, str(tmp_path), str(tmp_path / "gone"), str(tmp_path / "__pycache__")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == [".hidden", "_private.csv", "plain.csv", "x.csv"]
    assert files.list_files(spark, str(tmp_path / "gone")).count() == 0


def test_las_write_round_trip(spark, tmp_path):
    points = spark.range(1000).select(F.col("id").alias("point_idx"), *[(F.col("id") * 0.25).alias(c) for c in "xyz"]).repartition(3)
    out = str(tmp_path / "out")
    las.write_las(points, out)
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir()) == [".las"] * 3
    back = las.read_las(spark, out)
    assert {round(r.x, 2) for r in back.collect()} == {i * 0.25 for i in range(1000)}


def test_inventory(spark, tmp_path):
    make_las(tmp_path / "good.las", 10)
    (tmp_path / "bad.las").write_bytes(b"nope")
    (tmp_path / ".venv").mkdir()
    (tmp_path / ".venv" / "x.csv").write_text("a")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "T.CSV").write_text("a,b\n")
    (tmp_path / "sub" / "notes.md").write_text("n")
    listing = files.list_files(spark, str(tmp_path)).cache()
    assert listing.count() == 4
    counts = {r.extension: r.files for r in files.by_extension(listing).collect()}
    assert counts == {".las": 2, ".csv": 1}
    assert [r.size_bytes for r in files.large_files(listing, k=1, at_least=100).collect()] == [740]
    rows = {r.path.rsplit("/", 1)[1]: r for r in las.header_summary(listing, schemas.HEADER).collect()}
    assert rows["good.las"].header.point_count == 10 and rows["good.las"].error is None
    assert rows["bad.las"].header is None and "instead of" in rows["bad.las"].error
    root = listing.where("extension = '.md'").first().path.rsplit("/", 1)[0]
    expected = spark.createDataFrame(
        [("a", "Notes", root + "/notes.md"), ("b", "Folder", root), ("c", "Gone", root + "/gone"), ("d", "Unset", None)],
        "key string, label string, path string",
    )
    got = {r.key: (r.exists, r.size) for r in files.expected_status(expected, listing).collect()}
    assert got == {"a": (True, "1 B"), "b": (True, None), "c": (False, None), "d": (False, None)}


def test_sample_job_reads_windows_and_reports_bounds(spark, tmp_path):
    make_las(tmp_path / "a.las", 1000)
    out = str(tmp_path / "sample")
    got = jobs.sample_point_file(spark, str(tmp_path / "a.las"), 250, out).first()
    assert got.sampled_point_count == 250 and got.sampling_method.endswith("84_windows_3_records_each")
    assert (got.min_x, got.max_z) == (100.0, 996.0)  # the last window is cut to one record
    assert tables.read_points(spark, out).count() == 250
    assert got.source.endswith("a.las") and got.source_size == "33.6 KB" and got.output == out
    assert got.output_size != "0 B" and got.header.point_count == 1000
    both = jobs.sample_point_files(spark, [(str(tmp_path / "a.las"), n, f"{out}-{n}") for n in (10, 20)]).collect()
    assert [r.sampled_point_count for r in both] == [10, 20]


def test_inventory_job(spark, tmp_path):
    make_las(tmp_path / "a.las", 5)
    (tmp_path / "b.md").write_text("x")
    expected = spark.createDataFrame([("a", "Scan", None)], "key string, label string, path string")
    found = jobs.inventory(spark, [str(tmp_path)], expected)
    assert found.listing.count() == 1 and found.large_files.count() == 0
    assert found.headers.first().header.point_count == 5 and found.expected.first().exists is False


def test_a_failed_publication_shows_the_old_result_in_both_zones(spark, tmp_path, monkeypatch):
    zones = [str(tmp_path / "ready"), str(tmp_path / "served")]
    rows = lambda n: spark.range(n).select((F.col("id") % 4 - 1).alias("time_step"), "id")
    kind = "time_step bigint, id bigint"
    seen = lambda: [published.read_published(spark, z, kind).count() for z in zones]
    with pytest.raises(FileNotFoundError):
        published.current(spark, zones[0])
    first = published.publish(rows(10), *zones, partition_by="time_step")
    reader = published.read_published(spark, zones[1], kind)
    assert seen() == [10, 10]

    # The second zone can't be written: a file stands where its folder would be.
    plain = published.uuid.uuid4
    (tmp_path / "served" / "versions" / "taken").write_text("")
    monkeypatch.setattr(published.uuid, "uuid4", lambda: type("U", (), {"hex": "taken"})())
    with pytest.raises(Exception):
        published.publish(rows(20), *zones, partition_by="time_step")
    monkeypatch.setattr(published.uuid, "uuid4", plain)
    assert seen() == [10, 10] and published.current(spark, zones[0])[1]["version"] == first
    assert not (tmp_path / "ready" / "versions" / "taken").exists()

    second = published.publish(rows(30), *zones, partition_by="time_step")
    assert seen() == [30, 30] and reader.count() == 10
    third = published.publish(rows(40), *zones, partition_by="time_step")
    for zone in zones:
        assert sorted(x.name for x in (tmp_path / zone / "versions").iterdir()) == sorted([second, third])


def test_a_step_is_read_from_its_folder(spark, tmp_path):
    zone = str(tmp_path / "zone")
    rows = spark.range(60).select((F.col("id") % 6 - 2).cast("int").alias("time_step"), "id")
    published.publish(rows, zone, partition_by="time_step")
    kind = "time_step int, id bigint"
    for asked, step in ((3, 3), (-1, -1), (99, -2)):
        got = published.read_step(spark, zone, kind, asked)
        assert {r.time_step for r in got.collect()} == {step} and got.count() == 10
        assert {f.rsplit("/", 2)[1] for f in got.inputFiles()} == {f"time_step={step}"}
    assert published.read_step(spark, zone, kind, None).count() == 60
    published.publish(rows.where("false"), zone, partition_by="time_step")
    assert published.read_step(spark, zone, kind, 3).count() == 0


def test_a_step_is_published_in_few_files(spark, tmp_path):
    rows = spark.range(2000, numPartitions=20).select((F.col("id") % 3).cast("int").alias("time_step"), "id")
    zones = [f"{tmp_path}/{z}" for z in "ab"]
    version = published.publish(rows, *zones, partition_by="time_step")
    for zone in zones:
        assert all(len(list((tmp_path / zone / "versions" / version / f"time_step={k}").glob("*.parquet"))) <= 2 for k in range(3))
        assert sorted(r.id for r in published.read_published(spark, zone, "time_step int, id bigint").collect()) == list(range(2000))


def test_las_writer_holds_little_more_than_it_writes(tmp_path, monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0))
    n, k = 300_000, 10_000
    batches = (pa.record_batch([np.arange(i, i + k, dtype=float)] * 3, ["x", "y", "z"]) for i in range(0, n, k))
    tracemalloc.start()
    writer = las.LasWriter({"path": str(tmp_path)})
    writer.commit([writer.write(batches)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    header = las.read_header(las.point_files(str(tmp_path))[0])
    assert header["point_count"] == n and header["maxs"] == [n - 1.0] * 3 and header["mins"] == [0.0] * 3
