"""Windowed aggregations over a stream of events: extras beside the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scratch import Scratch


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").load(folder)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window; ``late`` is the watermark for streams."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start_at"), *by, "n", F.round("total", 4).alias("total")
    )


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("start_at"), (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).alias("seconds"), "n"
    )


def run_to_end(stream: DataFrame, scratch: Scratch, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its last result.

    Each batch writes its own table in the shared folder, so a batch that runs
    again overwrites its own result only.
    """
    spark = scratch.spark
    scratch._count += 1
    base = f"{scratch.root}/stream{scratch._count}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/batch{number}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(last[-1])
    return spark.read.schema(stream.schema).parquet(*dict.fromkeys(last))
