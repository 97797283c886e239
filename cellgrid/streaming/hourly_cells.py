"""Hourly activity of every cell as a stream with state: event time, watermark, late rows, redelivered events."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of events that arrive anywhere below ``folder``."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hourly_cells(
    events: DataFrame,
    activity_of: Mapping[str, str],
    *,
    id_col: str = "event_id",
    time_col: str = "ts",
    cell_col: str = "CellID",
    type_col: str = "event_type",
    value_col: str = "value",
    delay: str = "6 hours",
    width: str = "1 hour",
) -> DataFrame:
    """Sums per (cell, hour): ``CellID, datetime``, one column an activity, ``n_events``.

    Works on a stream and, as a plain aggregate, on a batch. On a stream, rows whose time is not after the watermark (latest time
    of earlier batches less ``delay``) are dropped; an event delivered again within the watermark counts once; an hour is given out,
    once and for good, when the watermark has passed its end. State holds the ids of the last ``delay`` and the sums
    of open hours, so it follows the rate of events and not the length of the stream. Rows without time or id are dropped.
    ``activity_of`` maps activity columns to event types; other types count in ``n_events`` only.
    """
    timed = events.where(F.col(time_col).isNotNull() & F.col(id_col).isNotNull()).withColumn("_at", F.col(time_col).cast("timestamp"))
    once = timed.withWatermark("_at", delay)
    once = once.dropDuplicatesWithinWatermark([id_col]) if events.isStreaming else once.dropDuplicates([id_col])
    sums = [F.sum(F.when(F.col(type_col) == kind, F.col(value_col))).alias(activity) for activity, kind in activity_of.items()]
    hours = once.groupBy(F.window("_at", width).alias("_w"), cell_col).agg(*sums, F.count(F.lit(1)).alias("n_events"))
    return hours.select(
        cell_col, F.col("_w.start").cast("timestamp_ntz").alias("datetime"), *[F.coalesce(a, F.lit(0.0)).alias(a) for a in activity_of], "n_events"
    )


@dataclass
class RunFigures:
    """What one run did: read and late rows, and rows left in the state."""

    batches: int = 0
    read: int = 0
    late: int = 0
    state_rows: int = field(default=0)


@contextmanager
def _settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of one stream; the session has its own again afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_available(hours: DataFrame, out: str, checkpoint: str, *, state_partitions: int | None = None) -> RunFigures:
    """Process what has arrived since the last run with this ``checkpoint`` and append closed hours to ``out`` as Parquet.

    The file sink's log makes a batch that is repeated after a failure count once. State is kept in RocksDB, outside the heap.
    Every batch commits two stores a state partition, however few rows they hold, and a checkpoint keeps the number of partitions it began
    with. By default that is one a core, and never more than the session's shuffle partitions, which follow the size of tables and not of the state.
    """
    spark = hours.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS_DB,
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB of disk a store, kept for ended runs too
        "spark.sql.shuffle.partitions": str(state_partitions or min(shuffles, max(1, spark.sparkContext.defaultParallelism))),
    }
    with _settings(spark, settings):
        query: StreamingQuery = (
            hours.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
    figures = RunFigures()
    for progress in query.recentProgress:
        figures.batches += 1
        figures.read += progress["numInputRows"]
        figures.late += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
        figures.state_rows = sum(s["numRowsTotal"] for s in progress["stateOperators"])
    return figures
