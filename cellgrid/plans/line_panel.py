"""A panel that grows with ``lineitem``: parts for cells of the full grid, order lines for activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import with_total_activity
from ..operators import allocation, neighbors, validation
from ..operators.collapse import collapse_country_codes
from ..operators.diagnosis import diagnose, predicted_risk
from ..operators.thresholds import flag_congestion
from ..session import materialise
from .event_panel import HOLIDAYS, UNIQUE_ORDER
from .queries import KEY, _rounded, query

GRID = 100
HOURS = 48


def raw_activity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (cell, hour, line number); ship days are folded to ``HOURS`` hours so that neighbours meet. Whole numbers only."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    hour = F.pmod(F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")), F.lit(HOURS))
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    keyed = lines.select(
        (start + F.make_dt_interval(hours=hour)).alias("datetime"),
        ((F.col("l_partkey") - 1) % (GRID * GRID) + 1).alias("CellID"),
        F.col("l_linenumber").cast("bigint").alias("countrycode"),
        F.round("l_quantity").alias("quantity"), F.round("l_extendedprice").alias("price"),
        F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"),
    )
    raw = keyed.groupBy("datetime", "CellID", "countrycode").agg(
        F.sum("quantity").alias("smsin"), F.sum("price").alias("smsout"), F.sum("discount").alias("callin"),
        F.sum("tax").alias("callout"), F.count(F.lit(1)).cast("double").alias("internet"),
    )
    return raw.withColumn("_source_file", F.date_format("datetime", "yyyy-MM-dd"))


def staged_panel(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(with_total_activity(collapse_country_codes(raw_activity(spark, folder))), "line-panel")


def staged_risk(spark: SparkSession, folder: str) -> DataFrame:
    flags = flag_congestion(staged_panel(spark, folder))
    return materialise(predicted_risk(flags, order=UNIQUE_ORDER), "line-risk")


@query
def wide_congestion_flags(spark, folder):
    flags = flag_congestion(staged_panel(spark, folder))
    return flags.select(*KEY, "total_activity", "congestion_threshold", "is_congestion_risk")


@query
def all_cell_percentile_ranks(spark, folder):
    """Percentile rank of every cell's mean among all cells' means."""
    ranks = validation.all_cell_percentile_ranks(staged_panel(spark, folder))
    return ranks.withColumns({c: _rounded(c) for c in ("mean_value", "percentile")})


@query
def wide_neighbor_average(spark, folder):
    averaged = neighbors.with_neighbor_average(staged_panel(spark, folder), grid_size=GRID)
    return averaged.select(*KEY, _rounded("neighbor_avg_activity").alias("neighbor_avg_activity"))


@query
def wide_diagnosis(spark, folder):
    found = diagnose(staged_risk(spark, folder), 1, holidays=HOLIDAYS, grid_size=GRID)
    return found.select(
        *KEY, "naive_forecast_1h", "congestion_threshold", "target_datetime_1h", "target_hour_key", "classification", "reason"
    )


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    risk = staged_risk(spark, folder)
    cases = allocation.routine_cases(diagnose(risk, 1, holidays=HOLIDAYS, grid_size=GRID))
    return materialise(allocation.candidate_edges(cases, allocation.capacity(risk), grid_size=GRID), "line-edges")


@query
def wide_candidate_edges(spark, folder):
    return _edges(spark, folder).withColumns({"deficit": _rounded("deficit"), "spare": _rounded("spare")})


@query
def wide_plan_violations(spark, folder):
    """Per hour with candidate edges: overdrawn cases and sources, and the gap to the proving cut (all zero)."""
    edges = _edges(spark, folder)
    checked = allocation.plan_check(edges, materialise(allocation.solve(edges), "plan"))
    return checked.select(
        "target_datetime", "cases_overdrawn", "sources_overdrawn",
        _rounded(F.abs(F.col("moved") - F.col("cut_capacity")), 3).alias("gap"),
    )
