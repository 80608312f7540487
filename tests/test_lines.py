"""Numbered lines against plain reading."""

import csv
import gzip
import random

import pytest
from pyspark.sql import functions as F

from adit.sources import lines, tables


def plain(path, header=True):
    """Lines that are not blank, by reading the whole file."""
    raw = path.read_bytes()
    raw = gzip.decompress(raw) if path.suffix == ".gz" else raw
    raw = raw.removeprefix(lines.MARK)
    found = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in raw.split(b"\n") if x.strip(bytes(range(33)))]
    return found[1:] if header else found


def numbered(spark, path, **kw):
    got = sorted(lines.read_numbered_lines(spark, str(path), **kw).collect(), key=lambda r: r.row_idx)
    assert [r.row_idx for r in got] == list(range(len(got)))
    return got


@pytest.mark.parametrize("range_bytes", [2, 7, 64, 1 << 20])
def test_any_range_size(spark, tmp_path, range_bytes, monkeypatch):
    rng = random.Random(range_bytes)
    pieces = ["a,b", "é,ü", "x" * 90, "", "  ", "1,2", "last"]
    ends = ["\n", "\r\n", "\n\n"]
    count = 3 if range_bytes < 7 else 40
    for name, tail in (("a.csv", ""), ("b.csv", "\n"), ("c.csv", "no end")):
        body = "h1,h2\r\n" + "".join(rng.choice(pieces) + rng.choice(ends) for _ in range(count)) + tail
        (tmp_path / name).write_bytes((lines.MARK if name == "b.csv" else b"") + body.encode())
    (tmp_path / "_hidden").write_text("h\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("h1,h2")
    got = numbered(spark, tmp_path, range_bytes=range_bytes)
    assert [r.line for r in got] == [x for name in "abc" for x in plain(tmp_path / f"{name}.csv")]
    for r in got:
        raw = (tmp_path / f"{'abc'[r.file_no]}.csv").read_bytes()
        assert raw[r.offset :].startswith(r.line.encode())
    assert [r.line for r in numbered(spark, tmp_path / "a.csv", header=False, range_bytes=range_bytes)] == plain(tmp_path / "a.csv", False)
    for most in (0, 1, 5):
        assert [r.line for r in numbered(spark, tmp_path, range_bytes=range_bytes, max_rows=most)] == [r.line for r in got[:most]]


def test_blocks_are_joined(tmp_path, monkeypatch):
    """Lines longer than what is read at a time, and blocks that end anywhere."""
    monkeypatch.setattr(lines, "READ_BYTES", 5)
    path = tmp_path / "a.csv"
    path.write_bytes(b"h\n" + b"".join(b"y" * n + b"\r\n" for n in (1, 3, 40, 0, 6, 5, 4)) + b"z")
    for step in (1, 3, 10, 1000):
        plan = lines.plan_lines(str(path), range_bytes=step)
        found = [lines.as_strings(raw, a, b).to_pylist() for part in plan.ranges() for raw, a, b, _ in lines.cut_lines(part)]
        assert sum(found, []) == plain(path)


def test_packed_and_broken_bytes(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"a_rather_long_header_line_for_so_small_a_file,b\n" + b"1,2\n" * 5000))
    (tmp_path / "b.csv").write_bytes(b"h\nok\n\xff\xfe broken \xc3\n")
    got = numbered(spark, tmp_path, range_bytes=9)
    assert len(got) == 5002 and [r.line for r in got[-2:]] == plain(tmp_path / "b.csv")


def test_missing_and_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lines.plan_lines(str(tmp_path / "gone"))
    assert lines.read_numbered_lines(spark, str(tmp_path)).count() == 0
    assert tables.read_indexed_csv(spark, str(tmp_path), ("a", "b")).columns == ["row_idx", "a", "b"]


def test_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a.x,b y,"c,c"\n"1, one",,"say ""hi"""\n2\n3,4,5,6\n')
    rows = tables.read_indexed_csv(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [("1, one", None, 'say "hi"', 0), ("2", None, None, 1), ("3", "4", "5", 2)]
    assert rows[0].__fields__ == next(csv.reader(['a.x,b y,"c,c"'])) + ["row_idx"]


@pytest.mark.parametrize("pattern", [False, True])
def test_numbers_do_not_hang_on_parallelism(spark, tmp_path, pattern):
    """The passes see different settings for splitting files, as when executors come and go."""
    for k in range(4):
        (tmp_path / f"p{k}.csv").write_text("n,z\n" + "".join(f"{k * 30_000 + i},{'z' * 20}\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 70_000)
        path = f"{tmp_path}/p*.csv" if pattern else str(tmp_path)
        rows = tables.read_indexed_csv(spark, path, ("n",), range_bytes=100_000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1_500_000)
        off, n, top, distinct = rows.agg(
            F.count_if(F.col("row_idx") != F.col("n").cast("bigint")), F.count("*"), F.max("row_idx"), F.count_distinct("row_idx")
        ).first()
        assert (off, n, top, distinct) == (0, 120_000, 119_999, 120_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
