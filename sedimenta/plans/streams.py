"""Queries that run as streams over the test tables, until all that has landed is in, with the SQL of their result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sedimenta.operators import merge as m
from sedimenta.session import ensure_checkpoint_dir, scan
from sedimenta.store import VersionedTable
from sedimenta.streaming.feeds import deduplicated, landed, upsert, windowed_counts


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, for the table may be one file or a folder of files
    ddl = ", ".join(f"{n} {t}" for n, t in scan(spark, d, "events").dtypes)
    return landed(spark, f"{d}/[e]vents.parquet", ddl, file_format="parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Newest event per user and type, merged batch by batch."""
    at = _folder(spark)
    events = _events(spark, d).select("user_id", "event_type", "event_id", "value")
    table = VersionedTable(spark, f"{at}/table", dict(events.dtypes), ["user_id", "event_type"])
    spec = m.newer_and_different(events.columns, table.keys, "event_id", "event_id")
    upsert(events, table, spec, f"{at}/checkpoint", order=lambda: [F.desc("event_id")]).awaitTermination()
    return table.read()


def _overwriting(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: (table.overwrite(batch), None)[1]


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type in tumbling windows."""
    at = _folder(spark)
    counts = windowed_counts(_events(spark, d), "ts", ["event_type"], delay="3650 days")
    table = VersionedTable(spark, f"{at}/table", dict(counts.dtypes), ["window_start", "event_type"])
    _drained(counts.writeStream.outputMode("complete").foreachBatch(_overwriting(table)), f"{at}/checkpoint")
    return table.read().select(F.col("window_start").cast("date").alias("day"), "event_type", "n")


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each event once although every one arrives twice."""
    at = _folder(spark)
    twice = _events(spark, d).select("event_id", "ts", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    once = deduplicated(twice, ["event_id"], "ts", "3650 days").select("event_id", "user_id")
    _drained(once.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows"), f"{at}/checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint").parquet(f"{at}/rows")


QUERIES = {"stream_upsert": stream_upsert, "stream_daily_counts": stream_daily_counts, "stream_distinct": stream_distinct}
ORACLES = {
    "stream_upsert": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_distinct": "SELECT event_id, user_id FROM events",
}
