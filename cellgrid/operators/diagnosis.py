"""Predicted risk per horizon and its classification as routine or anomalous."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    ANOMALOUS,
    GRID_SIZE,
    HORIZONS,
    KNOWN_HOLIDAYS,
    NEIGHBOR_FRACTION,
    REASON_HOLIDAY_SOURCE,
    REASON_HOLIDAY_TARGET,
    REASON_ISOLATED,
    REASON_NEIGHBORS,
    ROUTINE,
    SEASON_HOURS,
)
from ..functions.grid import neighbor_total
from ..functions.scalars import date_key, exceeds, fill_template, hour_key, shift_hours, source_date
from ..session import materialise
from .neighbors import with_neighbor_hits
from .series import shift_rows, shift_rows_blocked

# Holidays as literal dates, or as a calendar table with a date column.
Holidays = Iterable[str] | DataFrame


def predicted_risk(
    df: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    *,
    cell_col: str = "CellID",
    time_col: str = "datetime",
    order: Sequence[str] | None = None,
    long_series: bool = False,
) -> DataFrame:
    """Seasonal-naive forecast, strict risk flag and target time for each horizon, from one window.

    The forecast is the value ``24 - h`` rows back, that is, 24 hours before the target on
    hourly series.
    """
    order = list(order or ([time_col, "_source_file"] if "_source_file" in df.columns else [time_col]))
    shifts = {f"naive_forecast_{h}h": ("total_activity", SEASON_HOURS - h) for h in horizons}
    shift = shift_rows_blocked if long_series else shift_rows
    panel = shift(df, shifts, partition=[cell_col], order=order)
    added: dict[str, Column] = {}
    for h in horizons:
        added[f"predicted_risk_{h}h"] = exceeds(f"naive_forecast_{h}h", "congestion_threshold")
        added[f"target_datetime_{h}h"] = shift_hours(time_col, h)
    return panel.withColumns(added)


def risk_long(panel: DataFrame, horizons: Sequence[int] = HORIZONS, *, cell_col: str = "CellID") -> DataFrame:
    """Horizon as a column: one row per (row, horizon) with a forecast."""
    structs = [
        F.struct(
            F.lit(h).alias("horizon"),
            F.col(f"naive_forecast_{h}h").alias("forecast"),
            F.col(f"predicted_risk_{h}h").alias("predicted_risk"),
            F.col(f"target_datetime_{h}h").alias("target_datetime"),
        )
        for h in horizons
    ]
    own = {f"{name}_{h}h" for name in ("naive_forecast", "predicted_risk", "target_datetime") for h in horizons}
    keep = [c for c in panel.columns if c not in own]
    return panel.select(*keep, F.inline(F.array(*structs))).filter("forecast is not null")


def with_holiday_flags(df: DataFrame, target: str, holidays: Holidays = KNOWN_HOLIDAYS, date_column: str = "date") -> DataFrame:
    """Add ``_target_holiday`` and ``_source_holiday``."""
    dates = {"_target_holiday": date_key(target), "_source_holiday": source_date(target)}
    if isinstance(holidays, DataFrame):
        # One row per date, staged so that the planner sees its size and can broadcast it.
        days = holidays.select(F.col(date_column).cast("date").alias("_day")).filter("_day is not null").distinct()
        days = materialise(days, "calendar")
        for name, day in dates.items():
            mark = days.select(F.col("_day").alias(f"{name}_day"), F.lit(True).alias(name))
            df = df.join(mark, day == F.col(f"{name}_day"), "left").drop(f"{name}_day")
            df = df.withColumn(name, F.coalesce(name, F.lit(False)))
        return df
    listed = [F.lit(str(d)).cast("date") for d in holidays]
    return df.withColumns({n: (d.isin(*listed) if listed else F.lit(False)) for n, d in dates.items()})


def classify(
    flagged: DataFrame,
    *,
    target: str,
    holidays: Holidays = KNOWN_HOLIDAYS,
    cell_col: str = "CellID",
    grid_size: int = GRID_SIZE,
    fraction: float = NEIGHBOR_FRACTION,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``target_hour_key``, ``classification`` and ``reason`` to rows that are predicted at risk.

    In order: target on a holiday; enough neighbours at risk in the same hour; forecast copied
    from a holiday; isolated. The neighbour share is over the neighbours on the grid. Rows with
    different ``keys`` (such as the horizon) do not count for each other.
    """
    keyed = with_holiday_flags(flagged, target, holidays, "date").withColumn("target_hour_key", hour_key(target))
    counted = with_neighbor_hits(
        keyed, name="_hits", cell_col=cell_col, time_col="target_hour_key", grid_size=grid_size, keys=keys
    ).withColumn("_total", neighbor_total(cell_col, grid_size))
    share = F.coalesce(F.try_divide(F.col("_hits"), F.col("_total")), F.lit(0.0))
    parts = {"hits": F.col("_hits"), "total": F.col("_total")}
    routine_area = share >= fraction
    by_class = (
        F.when(F.col("_target_holiday"), ROUTINE).when(routine_area, ROUTINE).otherwise(ANOMALOUS)
    )
    reason = (
        F.when(F.col("_target_holiday"), REASON_HOLIDAY_TARGET)
        .when(routine_area, fill_template(REASON_NEIGHBORS, **parts))
        .when(F.col("_source_holiday"), REASON_HOLIDAY_SOURCE)
        .otherwise(fill_template(REASON_ISOLATED, **parts))
    )
    return counted.withColumns({"classification": by_class, "reason": reason}).select(
        *flagged.columns, "target_hour_key", "classification", "reason"
    )


def diagnose(
    panel: DataFrame,
    horizon: int = 1,
    *,
    holidays: Holidays = KNOWN_HOLIDAYS,
    cell_col: str = "CellID",
    grid_size: int = GRID_SIZE,
    fraction: float = NEIGHBOR_FRACTION,
) -> DataFrame:
    """Classified rows of one horizon; ``panel`` comes from :func:`predicted_risk`. Schema is the same when empty."""
    return classify(
        panel.filter(F.col(f"predicted_risk_{horizon}h")),
        target=f"target_datetime_{horizon}h",
        holidays=holidays, cell_col=cell_col, grid_size=grid_size, fraction=fraction,
    )


def diagnose_all(
    panel: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    *,
    holidays: Holidays = KNOWN_HOLIDAYS,
    cell_col: str = "CellID",
    grid_size: int = GRID_SIZE,
    fraction: float = NEIGHBOR_FRACTION,
) -> DataFrame:
    """All horizons as one long frame, classified in one pass: cell, horizon, target, forecast, threshold, class, reason."""
    flagged = risk_long(panel, horizons, cell_col=cell_col).filter("predicted_risk").select(
        cell_col, "horizon", "target_datetime", F.col("forecast").alias("naive_forecast"), "congestion_threshold"
    )
    return classify(
        flagged, target="target_datetime", holidays=holidays, cell_col=cell_col, grid_size=grid_size,
        fraction=fraction, keys=["horizon"],
    ).drop("target_hour_key")


def class_shares(diagnosed: DataFrame, n_rows: DataFrame | None = None) -> DataFrame:
    """Count and share per class; with ``n_rows`` (a frame of all rows) also the flagged share of it."""
    counts = diagnosed.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    total = diagnosed.agg(F.count(F.lit(1))).scalar()
    shares = counts.withColumn("share", F.try_divide(F.col("n"), total))
    if n_rows is not None:
        everything = n_rows.agg(F.count(F.lit(1))).scalar()
        shares = shares.withColumn("flagged_share", F.try_divide(total, everything))
    return shares
