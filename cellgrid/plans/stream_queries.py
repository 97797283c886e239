"""Queries that let a table's rows arrive as files, run the streams over them, and are compared as any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import ACTIVITY_COLUMNS
from ..session import stage_path
from ..streaming.hourly_cells import hourly_cells, run_available, stream_events
from . import event_panel as ep
from .queries import KEY, query

ARRIVALS = 6
LATE_EVERY, LATE_HOURS = 5, 97  # every fifth event arrives up to 96 hours late
AGAIN_EVERY = 7  # every seventh event is delivered once more, with the next arrival
DELAY_HOURS = 24


def _arrival(events: DataFrame) -> Column:
    """Number of the arrival an event comes with: its time plus its delay, in ``ARRIVALS`` equal stretches of the table's time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    delay = F.when(F.col("event_id") % LATE_EVERY == 0, (F.col("event_id") * 37) % LATE_HOURS).otherwise(F.lit(0)) * F.lit(3_600_000_000)
    first, last = events.agg(F.min(micros)).scalar(), events.agg(F.max(micros)).scalar()
    place = F.floor((micros + delay - first) * ARRIVALS / (last - first + 1))
    return F.least(place, F.lit(ARRIVALS - 1)).cast("int")


def _arrivals(spark: SparkSession, folder: str) -> str:
    """Folders ``slot=k`` of event files, written in one pass."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "ts", (F.col("user_id") % (ep.GRID * ep.GRID) + 1).alias("CellID"), "event_type", F.round(F.col("value") * 100).alias("value"),
    )
    again = F.when((F.col("event_id") % AGAIN_EVERY == 0) & (F.col("slot") < ARRIVALS - 1), F.array(F.col("slot"), F.col("slot") + 1))
    slotted = events.withColumn("slot", _arrival(events)).withColumn("slot", F.explode(F.coalesce(again, F.array("slot"))))
    path = stage_path(spark, "arrivals")
    slotted.write.partitionBy("slot").parquet(path)
    return path


@query
def streamed_hourly_cells(spark, folder):
    """Six arrivals with late and redelivered events; after each the stream is started anew from its checkpoint."""
    arrivals, watched = _arrivals(spark, folder), stage_path(spark, "watched")
    out, checkpoint = stage_path(spark, "hours"), stage_path(spark, "stream-state")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(arrivals).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(watched))
    schema = spark.read.parquet(arrivals).drop("slot").schema
    activity_of = {a: kind for kind, a in ep.ACTIVITY_OF_EVENT.items()}
    for slot in range(ARRIVALS):
        files.rename(path(f"{arrivals}/slot={slot}"), path(f"{watched}/slot={slot}"))
        run_available(hourly_cells(stream_events(spark, watched, schema), activity_of, delay=f"{DELAY_HOURS} hours"), out, checkpoint)
    return spark.read.parquet(out).select(*KEY, *ACTIVITY_COLUMNS, "n_events")
