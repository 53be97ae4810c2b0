"""Sheets: tables that people mark rows in, kept as versioned snapshots behind one pointer, so that a failed run changes nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Sheets:
    """Sheets below a folder: root/name/v<number>-<id>, Parquet files of one version, and root/name/CURRENT, which names the version that counts.

    Writing makes a new version, then a new pointer beside the old one, then renames it over the old one, which is one step of the file system, then
    removes versions older than the last two. Whatever stops in between leaves CURRENT at a whole version; what such a run left is
    removed by the next one. One writer at a time; readers of the version before aren't disturbed.
    """

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def current(self, name: str) -> str | None:
        """The version that counts; None for a sheet that was never written."""
        at = self._path(name, self.POINTER)
        if not self._fs().exists(at):
            return None
        stream = self._fs().open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def versions(self, name: str) -> list[str]:
        at = self._path(name)
        if not self._fs().exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs().listStatus(at)) if re.fullmatch(r"v\d{8}-\w+", n))

    def read(self, name: str) -> DataFrame | None:
        version = self.current(name)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> str:
        """rows become the sheet; they may be made from what read gave. Returns the version."""
        before = self.current(name)
        version = f"v{int(before[1:9]) + 1 if before else 1:08d}-{uuid.uuid4().hex[:8]}"
        self._snapshot(name, version, rows)
        pending = self._point(name, version)
        self._swap(name, pending)
        self._sweep(name, {version, before})
        return version

    def _snapshot(self, name: str, version: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/{name}/{version}")

    def _point(self, name: str, version: str) -> str:
        pending = f"{self.POINTER}.{version}"
        out = self._fs().create(self._path(name, pending), True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        return pending

    def _swap(self, name: str, pending: str) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        target = self._path(name, self.POINTER)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf).rename(self._path(name, pending), target, how)

    def _sweep(self, name: str, keep: set) -> None:
        for version in self.versions(name):
            if version not in keep:
                self._fs().delete(self._path(name, version), True)
        for status in self._fs().listStatus(self._path(name)):
            if status.getPath().getName().startswith(f"{self.POINTER}."):
                self._fs().delete(status.getPath(), False)
