"""The incremental registry as a stream: each micro-batch is validated, classified and published as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.registry import merge
from ..operators.scratch import Scratch
from ..operators.store import VersionedTable


class Duplicate(RuntimeError):
    """A key stands in a batch more than once; nothing of the batch is published."""


class Regression(RuntimeError):
    """A capture is older than what the registry holds; nothing of its batch is published."""


class RegistryStream:
    """Keyed upserts of a stream into versioned tables.

    A late record isn't dropped by a watermark: it fails its batch before
    anything is written, and the version before stays the current one. Keys
    that a batch lacks are kept. A batch that runs again starts from the
    version before it, so results don't depend on retries.

    With a ``store`` the versions and the stream's checkpoint are kept there, and
    a new session goes on from them; a version holds only the keys of its batch.
    With ``unique`` a key that a batch holds twice is an error; else the last of
    its captures counts.
    """

    def __init__(
        self, scratch: Scratch, key: str, order: list[str], content: Column, strict: bool = True, unique: bool = False,
        store: VersionedTable | None = None,
    ):
        self.scratch, self.key, self.order, self.content, self.strict = scratch, key, order, content, strict
        self.unique, self.store = unique, store
        self.versions: dict[int, DataFrame] = {}
        self.states: dict[int, DataFrame] = {}
        self.watermarks: dict[int, object] = {}

    def before(self, number: int) -> DataFrame | None:
        if self.store is not None:
            return self.store.latest(number - 1)
        earlier = [n for n in self.versions if n < number]
        return self.versions[max(earlier)] if earlier else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.where(F.col(self.key).isNotNull()).persist()
        try:
            if self.unique and batch.groupBy(self.key).count().where("count > 1").limit(1).count():
                raise Duplicate(f"batch {number} holds a key twice")
            if self.store is not None and number in self.store.versions():
                return  # published before the session ended
            registry = self.before(number)
            if registry is not None and self.strict:
                first = self.order[0]
                held = registry.select(self.key, F.col(first).alias("__held"))
                if batch.join(held, self.key).where(F.col(first) < F.col("__held")).limit(1).count():
                    raise Regression(f"batch {number} regresses")
            merged, states = merge(registry, batch, self.key, self.order, self.content)
            if self.store is not None:
                new = merged.join(batch.select(self.key).distinct(), self.key, "left_semi")
                self.store.publish(new.select(*(f.name for f in self.store.read_schema())), number)
            else:
                self.versions[number] = self.scratch.save(merged)
            self.states[number] = self.scratch.save(states.withColumn("batch", F.lit(number)))
            self.watermarks[number] = batch.agg(F.max(self.order[0])).first()[0]
        finally:
            batch.unpersist()

    def run(self, stream: DataFrame) -> DataFrame:
        """Runs to the end of what is there; returns the registry's current version."""
        self.scratch._count += 1
        place = f"{self.scratch.root}/registry{self.scratch._count}" if self.store is None else f"{self.store.path}/checkpoint"
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.store.latest() if self.store is not None else self.versions[max(self.versions)]
