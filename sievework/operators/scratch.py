"""Intermediate tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEST_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all executors are on this machine
    (tests) a folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEST_FOLDERS:
        _TEST_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return _TEST_FOLDERS[app]


class Scratch:
    """Tables written below the checkpoint folder, each under a new name.

    ``save`` runs the plan once, writes it as Parquet and returns a frame
    that reads it; ``drop`` deletes tables that no later plan reads. What is
    left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/sievework-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0
        atexit.register(self._clear)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already
            pass

    def save(self, frame: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        schema = frame.schema
        frame.write.parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                self._delete(path)
