"""Streaming queries over the events, with the SQL of the same result in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources.tables import scratch
from siltstone.streaming import views as V

LATE = "10 minutes"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, followed by one row long after them that lets every window close."""
    path = scratch(spark, "events")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    end.write.mode("append").parquet(path)
    return V.source(spark, path, rows.schema, 100)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = V.finished(V.windowed(events(spark, d), "ts", "1 hour", None, LATE, ["event_type"], n=F.count(F.lit(1))), "update")
    return V.last_updates(out, ["ws", "event_type"]).filter("event_type <> 'end'")


@query("stream_sliding", "SELECT b + INTERVAL (k * 30) MINUTE AS ws, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, unnest([0, -1]) AS k FROM events) GROUP BY 1")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = V.finished(V.windowed(events(spark, d).filter("event_type <> 'end'"), "ts", "1 hour", "30 minutes", LATE, [], n=F.count(F.lit(1))), "update")
    return V.last_updates(out, ["ws"])


@query("stream_session", "SELECT user_id, min(ts) AS ws, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    out = V.finished(V.sessions(events(spark, d), "ts", "1 hour", LATE, ["user_id"], n=F.count(F.lit(1))), "append")
    return out.filter("user_id >= 0").select("user_id", "ws", "n")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return V.finished(V.distinct_within(events(spark, d).filter("user_id >= 0"), "ts", "60 days", ["user_id"]), "append").select("user_id")


@query("incremental_view", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS n, round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END), 4) AS value FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) <> 0")
def incremental_view(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "changes")
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "value", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"))
    rows.repartition(3).write.parquet(path)
    view = V.IncrementalView(spark, ["user_id"], ["value"])
    view.follow(V.source(spark, path, rows.schema))
    return view.read().select("user_id", "n", F.round("value", 4).alias("value"))
