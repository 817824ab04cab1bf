"""Streams: landed lines upserted as they arrive, and windowed counts of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators.merge import MergeSpec
from sedimenta.operators.select import newest
from sedimenta.store import VersionedTable


def landed(spark: SparkSession, folder: str, ddl: str, *, files_per_batch: int = 100, file_format: str = "json") -> DataFrame:
    """Files of a folder as a stream; which ones were read is kept in the query's checkpoint."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(folder)


def upsert(stream: DataFrame, table: VersionedTable, spec: MergeSpec, checkpoint: str, *, order: Callable[[], list]) -> StreamingQuery:
    """Merge every micro-batch into ``table`` and stop when what has landed is in.

    Within a batch the newest row per key counts; across batches the
    specification guards against stale rows, so a replayed batch after a
    failure changes nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        table.merge(newest(batch, list(spec.keys), order()), spec, unique=False)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each key within the time that rows may be late."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], *, window: str = "1 day", delay: str | None = "1 hour") -> DataFrame:
    """Counts per tumbling window; rows later than ``delay`` are past it (None: the stream has its watermark already)."""
    marked = stream.withWatermark(at, delay) if delay else stream
    agg = marked.groupBy(F.window(at, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
