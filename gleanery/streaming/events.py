"""Structured Streaming twins of the log operators.

Window counts run in update mode, where rows behind the watermark are dropped
and state of closed windows is freed; sessions, which Spark cannot update, keep
their state to the end.

Each stream reads the events file source, runs to the end of what is there and
leaves its result in the shared checkpoint folder, from where it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.session import ensure_checkpoint_dir, table


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def run_to_end(stream: DataFrame, mode: str, keys: tuple = ()) -> DataFrame:
    """Process all available input and read the sink's last state. In update mode
    every batch adds the rows it changed, and the last one of each key counts."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    out = f"{base}/out"

    def sink(batch: DataFrame, number: int) -> None:
        how = "overwrite" if mode == "complete" else "append"
        batch.withColumn("batch", F.lit(number)).write.mode(how).parquet(out)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(out)
    if mode != "update":
        return rows.drop("batch")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("newest", newest).where("newest = 1").drop("batch", "newest")


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select("event_type", F.unix_timestamp("window.start").alias("started"), "n")
    )


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select("event_type", F.unix_timestamp("window.start").alias("started"), "n")
    )


def sessions(events: DataFrame, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Asks per run; an event exactly at the gap still belongs to the session."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first"))
        .select("user_id", F.unix_timestamp("first").alias("started"), "n_events")
    )


def deduplicated(events: DataFrame, delay: str = "40 days") -> DataFrame:
    """One row per event id within the watermark (idempotent replay)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type."""
    return run_to_end(tumbling(event_stream(spark, sf)), "update", ("event_type", "started"))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events per two hours sliding by one."""
    return run_to_end(sliding(event_stream(spark, sf)), "update", ("event_type", "started"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Asks as session windows."""
    return run_to_end(sessions(event_stream(spark, sf)), "complete")


def stream_dedup_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """H4: events once per id."""
    return run_to_end(deduplicated(event_stream(spark, sf)), "append")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedup_watermark)}
SQL = {
    "stream_tumbling": """SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS started, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
    "stream_sliding": """SELECT event_type, CAST((floor(epoch(ts) / 3600) - o) * 3600 AS BIGINT) AS started, CAST(count(*) AS BIGINT) AS n
        FROM events, (SELECT 0 AS o UNION ALL SELECT 1) GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 120 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, k""",
    "stream_dedup_watermark": "SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY event_id",
}
