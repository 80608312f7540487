"""Results published to several zones in one commit, and served step by step.

Every zone gets a folder with the new version of the data. The version becomes
current when one manifest, to which all zones point, is replaced. Whoever reads
meanwhile, or after a failure half way, finds the version before, in all zones.

The manifest also lists the values that the data are partitioned by, so a
question about one step opens that step's folder and nothing else.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST, POINTER, VERSIONS = "_manifest.json", "_zone.json", "versions"


class Store:
    """Small files and folders of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def read(self, path: str) -> dict:
        fs, target = self._at(path)
        with_stream = fs.open(target)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))
        finally:
            with_stream.close()

    def replace(self, path: str, content: dict) -> None:
        """Write beside the file and move over it, so that no reader sees a part of it."""
        fs, staged = self._at(f"{path}-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(json.dumps(content).encode())
        out.close()
        how = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(fs.makeQualified(staged), fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path)), options)

    def folders(self, path: str) -> list[str]:
        fs, target = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []

    def remove(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)


def publish(df: DataFrame, *zones: str, partition_by: str | None = None) -> str:
    """Write ``df`` to every zone and make it current in all of them at once; returns the version.

    The first zone keeps the manifest, for good. The version before stays for
    those who read it; older ones are deleted. A failure leaves everything as
    it was.

    ``df`` is computed once, for the first zone; the others get what was written
    there. Rows of one partition are brought together first, so a folder has a
    file per large share of its rows and not one per task.
    """
    store, version = Store(df.sparkSession), uuid.uuid4().hex
    manifest = f"{zones[0].rstrip('/')}/{MANIFEST}"
    before = store.read(manifest) if store.exists(manifest) else {}
    folders = [f"{zone.rstrip('/')}/{VERSIONS}/{version}" for zone in zones]
    dealt = df if partition_by is None else df.hint("rebalance", partition_by)
    try:
        for folder in folders:
            writer = dealt.write if partition_by is None else dealt.write.partitionBy(partition_by)
            writer.parquet(folder)
            dealt = df.sparkSession.read.schema(df.schema).parquet(folders[0]).select(*df.columns)
        values = [name.split("=", 1)[1] for name in store.folders(folders[0])] if partition_by else None
        for zone in zones:
            pointer = f"{zone.rstrip('/')}/{POINTER}"
            if not store.exists(pointer) or store.read(pointer)["manifest"] != manifest:
                store.replace(pointer, {"manifest": manifest})
        store.replace(manifest, {"version": version, "before": before.get("version"), "partition_by": partition_by, "values": values})
    except BaseException:
        for folder in folders:
            store.remove(folder)
        raise
    for zone in zones:
        for name in store.folders(f"{zone.rstrip('/')}/{VERSIONS}"):
            if name not in (version, before.get("version")):
                store.remove(f"{zone.rstrip('/')}/{VERSIONS}/{name}")
    return version


def current(spark: SparkSession, zone: str) -> tuple[str, dict]:
    """Folder of a zone's current version, and the manifest."""
    store = Store(spark)
    if not store.exists(f"{zone.rstrip('/')}/{POINTER}"):
        raise FileNotFoundError(f"nothing has been published to {zone}")
    manifest = store.read(store.read(f"{zone.rstrip('/')}/{POINTER}")["manifest"])
    return f"{zone.rstrip('/')}/{VERSIONS}/{manifest['version']}", manifest


def read_published(spark: SparkSession, zone: str, schema: str) -> DataFrame:
    """The current version; a version once read stays the same."""
    return spark.read.schema(schema).parquet(current(spark, zone)[0])


def read_step(spark: SparkSession, zone: str, schema: str, time_step: int | None = 0) -> DataFrame:
    """Rows of one step of a result published by step; none: of all of them.

    A step that does not occur gives way to the smallest one. The step is
    chosen from the manifest, and only its folder is listed and read.
    """
    folder, manifest = current(spark, zone)
    steps = sorted(int(v) for v in manifest["values"] or () if v.lstrip("-").isdigit())
    reader = spark.read.schema(schema).option("basePath", folder)
    if time_step is None or not steps:
        return reader.parquet(folder)
    chosen = time_step if time_step in steps else steps[0]
    return reader.parquet(f"{folder}/{manifest['partition_by']}={chosen}")
