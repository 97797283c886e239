"""Activity panel over an ``events`` table: event types stand for activities, users for cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import hour_key, with_total_activity
from ..operators.collapse import collapse_country_codes
from ..operators.diagnosis import diagnose, predicted_risk
from ..operators.thresholds import flag_congestion
from ..session import materialise

# The five event types in the place of the five activities.
ACTIVITY_OF_EVENT = {
    "view": "smsin", "click": "smsout", "signup": "callin", "purchase": "callout", "error": "internet",
}
GRID = 5
HOLIDAYS = ("2024-01-01", "2024-01-06")
# The day of a row stands for the daily file it would come from.
UNIQUE_ORDER = ("datetime", "_source_file")


def raw_activity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (cell, hour, country code), activities in integer cents, NULL where there was none."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    cents = F.round(F.col("value") * 100)
    keyed = events.select(
        hour_key("ts").alias("datetime"),
        (F.col("user_id") % (GRID * GRID) + 1).alias("CellID"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint").alias("countrycode"),
        "event_type",
        cents.alias("cents"),
    )
    sums = [
        F.sum(F.when(F.col("event_type") == event, F.col("cents"))).alias(activity)
        for event, activity in ACTIVITY_OF_EVENT.items()
    ]
    raw = keyed.groupBy("datetime", "CellID", "countrycode").agg(*sums)
    return raw.withColumn("_source_file", F.date_format("datetime", "yyyy-MM-dd"))


def collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_country_codes(raw_activity(spark, folder))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return with_total_activity(collapsed(spark, folder))


def staged_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel as a stage table: the events are read once, however many consumers it has."""
    return materialise(panel(spark, folder), "panel")


def flagged_panel(spark: SparkSession, folder: str) -> DataFrame:
    return flag_congestion(staged_panel(spark, folder))


def risk_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Flags with forecasts and risk for all horizons."""
    return predicted_risk(flagged_panel(spark, folder), order=UNIQUE_ORDER)


def staged_risk_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Stage table for consumers that need both the diagnosis and the capacities."""
    return materialise(risk_panel(spark, folder), "risk")


def diagnosis(risk: DataFrame, horizon: int = 1) -> DataFrame:
    return diagnose(risk, horizon, holidays=HOLIDAYS, grid_size=GRID)


def even_moves(edges: DataFrame) -> DataFrame:
    """A feasible plan with closed-form amounts: every edge moves a tenth of what it could at most
    (a case or source has at most eight edges).

    The best plan's amounts are not unique, so queries that show single amounts use this one.
    """
    return edges.select(
        "target_datetime", "congested_cell", "source_cell",
        F.least(F.col("deficit") / 10, F.col("spare") / 10).alias("amount_moved"),
    )
