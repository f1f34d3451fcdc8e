"""Versioned state of a pipeline: staged parquet tables, published together by one manifest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.plans.node import Patch

#: Patches of a table after which it is written whole again.
PATCHES = 8


class StoreError(RuntimeError):
    pass


class Store:
    """Parquet tables under ``path`` on any Hadoop file system.

    Each commit writes new tables or patches of tables under ``data/`` and then renames its manifest into ``manifest/<version>.json``. A
    reader pins a version; what no manifest names was never committed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifest"))

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (default: the last); an empty one before the first commit."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}, "shape": None}
        stream = self._fs.open(self._Path(f"{self.path}/manifest/{version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def read(self, manifest: dict) -> dict[str, dict[str, DataFrame]]:
        """node -> table -> DataFrame."""
        return {node: {t: self.table(parts) for t, parts in tables.items()} for node, tables in manifest["tables"].items()}

    def table(self, parts: list[dict]) -> DataFrame:
        """A table from its whole part, if it has one, and the later patches; of each key the last patch counts."""
        whole = self.spark.read.parquet(parts[0]["path"]) if not parts[0]["keys"] else None
        patches = parts if whole is None else parts[1:]
        if not patches:
            return whole
        keys = patches[0]["keys"]
        rows = None
        for n, p in enumerate(patches):
            part = self.spark.read.parquet(p["path"]).withColumn("__part", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        if len(patches) > 1:
            rows = rows.withColumn("__last", F.max("__part").over(Window.partitionBy(*keys))).filter("__part = __last").drop("__last")
        return Patch(rows.drop("__part"), keys).applied(whole)

    def add(self, tables: dict, node: str, table: str, change: DataFrame | Patch) -> list[str]:
        """Stages a change and notes it in ``tables``; a table with many patches is written whole. Gives the new paths."""
        parts = tables.setdefault(node, {}).get(table, [])
        if isinstance(change, Patch) and len(parts) < PATCHES:
            p = self.stage(node, table, change.rows)
            tables[node][table] = [*parts, {"path": p, "keys": change.keys}]
        else:
            df = change if isinstance(change, DataFrame) else change.applied(self.table(parts))
            p = self.stage(node, table, df)
            tables[node][table] = [{"path": p, "keys": []}]
        return [p]

    def stage(self, node: str, table: str, df: DataFrame) -> str:
        """Writes a table where no manifest points yet; gives its path."""
        p = f"{self.path}/data/{node}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(p)
        return p

    def discard(self, paths: list[str]) -> None:
        for p in paths:
            self._fs.delete(self._Path(p), True)

    def publish(self, manifest: Mapping) -> None:
        """Makes a commit visible; fails if another writer took its version.

        The rename is atomic on file systems with atomic renames, such as HDFS; on object stores there may be one
        writer only.
        """
        final = self._Path(f"{self.path}/manifest/{manifest['version']}.json")
        temp = self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(dict(manifest)).encode()))
            out.hsync()
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise StoreError(f"version {manifest['version']} was committed by another writer")

    def vacuum(self, keep: int = 2, older_than_ms: int = 0) -> int:
        """Deletes manifests but the last ``keep`` and the young ones, and the tables only they name; gives the number of tables deleted."""
        versions = self.versions()
        if older_than_ms:
            born = {int(s.getPath().getName()[:-5]): s.getModificationTime() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest")) if s.getPath().getName()[:-5].isdigit()}
            keep = max(keep, sum(born[v] > time.time() * 1000 - older_than_ms for v in versions))
        kept = {p for v in versions[-keep:] for ts in self.manifest(v)["tables"].values() for t in ts.values() for p in (x["path"] for x in t)}
        old = {p for v in versions[:-keep] for ts in self.manifest(v)["tables"].values() for t in ts.values() for p in (x["path"] for x in t)} - kept
        for v in versions[:-keep]:
            self._fs.delete(self._Path(f"{self.path}/manifest/{v}.json"), False)
        self.discard(sorted(old))
        return len(old)
