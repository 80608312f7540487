"""Run registered queries against their SQL twins: ``python -m adit.checks.compare [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from adit.checks.oracles import ORACLES
from adit.checks.queries import registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return ("f", None) if math.isnan(v) else round(v, 6) + 0.0
    return v


def kind(t: str) -> str:
    """Spark and DuckDB type names on common ground."""
    names = {"number": "?", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "string": "varchar"}
    return names.get(t.lower(), t.lower())


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def differences(spark, con, name, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    if name not in ORACLES:
        return "no SQL counterpart"
    df = registered()[name](spark, sf_dir)
    got = df.collect()
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {d[0]: kind(str(d[1])) for d in result.description}
    other = {c: kind(t) for c, t in df.dtypes}
    if kinds != other:
        return f"types {[(c, other[c], kinds[c]) for c in kinds if kinds[c] != other[c]]}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} of {len(a)} differ, e.g. {off[0]}" if off else None


def main(argv):
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(registered())
    spark, sf_dir = session(), f"/root/testdata/sf{sf}"
    con, bad = duck(sf_dir), 0
    for name in names:
        t = time.time()
        try:
            problem = differences(spark, con, name, sf_dir)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
