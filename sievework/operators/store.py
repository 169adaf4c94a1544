"""Versioned tables: each version is published whole or not at all, and outlives the session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"version=(\d+)\Z")


class Conflict(RuntimeError):
    """The version to be published is there already."""


class VersionedTable:
    """A table kept as versions below a folder that all executors share.

    A version is written beside the others and gets its name by one rename, so
    readers see all of it or nothing, and of two writers of one version one
    fails. A version holds the rows that changed; ``latest`` puts them together
    by key, the newest row counting. Every ``compact_after`` versions one holds
    all rows and the ones before are no longer read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, compact_after: int = 8):
        self.spark, self.path, self.schema, self.key, self.compact_after = spark, path.rstrip("/"), schema, key, compact_after

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def read_schema(self):
        """Fields of the table, in order."""
        return self.spark.createDataFrame([], self.schema).schema

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(m[1]) for m in map(_VERSION.match, names) if m)

    def read(self, number: int) -> DataFrame:
        """The rows that version ``number`` holds."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={number}")

    def latest(self, upto: int | None = None) -> DataFrame | None:
        """One row per key as of version ``upto`` (the newest unless given); None before the first."""
        known = [n for n in self.versions() if upto is None or n <= upto]
        if not known:
            return None
        base = max((n for n in known if n % self.compact_after == 0), default=known[0])
        parts = [self.read(n).withColumn("__version", F.lit(n)) for n in known if n >= base]
        if len(parts) == 1:
            return parts[0].drop("__version")
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        names = [c for c in both.columns if c not in (self.key, "__version")]
        newest = both.groupBy(self.key).agg(F.max_by(F.struct(*names), "__version").alias("r"))
        return newest.select(self.key, "r.*")

    def publish(self, changed: DataFrame, number: int | None = None) -> int:
        """Publish the changed rows as the next version, or as ``number``; returns it."""
        known = self.versions()
        number = (max(known) + 1 if known else 0) if number is None else number
        if known and number % self.compact_after == 0:
            held = self.latest(number - 1)
            changed = changed if held is None else held.join(changed.select(self.key), self.key, "left_anti").unionByName(changed.select(held.columns))
        fs, path = self._fs()
        staged, target = path(f"{self.path}/.staged-{uuid.uuid4().hex}"), path(f"{self.path}/version={number}")
        changed.write.parquet(staged.toString())
        # A rename onto a folder that is there would move into it.
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, True)
            raise Conflict(f"version {number} is there already")
        return number
