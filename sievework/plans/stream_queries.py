"""Queries of streams; ``extra_`` marks what goes beyond the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..sources.tables import table
from ..streaming import upserts, windows


def _events(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, folder, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, folder, "events").schema
    return windows.read_stream(spark, folder, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _dated(frame):
    return frame.withColumn("start_at", F.col("start_at").cast("string"))


def extra_events_tumbling(spark, folder):
    return _dated(windows.tumbling(_events(spark, folder), "ts", "1 day", ["event_type"], "value"))


def extra_events_session(spark, folder):
    return _dated(windows.sessions(_events(spark, folder), "ts", "30 minutes", "user_id"))


def extra_stream_tumbling(spark, folder):
    """The tumbling counts, as a stream read to its end."""
    return _dated(windows.run_to_end(windows.tumbling(_stream(spark, folder), "ts", "1 day", ["event_type"], "value", "1 hour"), Scratch(spark)))


def stream_registry(spark, folder):
    """The last event of every user, kept by a stream of upserts."""
    content = F.concat_ws("|", "event_type", F.col("value").cast("string"))
    registry = upserts.RegistryStream(Scratch(spark), "user_id", ["ts", "event_id"], content)
    return registry.run(_stream(spark, folder).where("user_id is not null")).select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (extra_events_tumbling, extra_events_session, extra_stream_tumbling, stream_registry)}
_TUMBLING = "SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
SQL = {
    "extra_events_tumbling": _TUMBLING,
    "extra_stream_tumbling": _TUMBLING,
    "extra_events_session": """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
        FROM events WHERE ts IS NOT NULL), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
        SELECT user_id, min(ts)::VARCHAR AS start_at, (floor(epoch(max(ts)) + 1800) - floor(epoch(min(ts))))::BIGINT AS seconds, count(*) AS n FROM g GROUP BY user_id, s""",
    "stream_registry": """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
        FROM events WHERE user_id IS NOT NULL) WHERE n = 1""",
}
