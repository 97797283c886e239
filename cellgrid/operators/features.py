"""Feature tables for forecasting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import GENERIC_LAGS, GRID_SIZE, HORIZONS, LAGS, SEASON_HOURS
from ..functions.scalars import day_of_week, hour_of, is_weekend
from .neighbors import with_neighbor_average
from .series import shift_hours_aligned, shift_rows, shift_rows_blocked

CALENDAR_FEATURES = ("hour_of_day", "day_of_week", "is_weekend")
NEIGHBOR_FEATURE = "neighbor_avg_lag1h"


@dataclass(frozen=True)
class FeatureNames:
    lags: tuple[int, ...] = LAGS
    horizons: tuple[int, ...] = HORIZONS

    @property
    def features(self) -> list[str]:
        return [f"lag_{k}h" for k in self.lags] + [*CALENDAR_FEATURES, NEIGHBOR_FEATURE]

    @property
    def required(self) -> list[str]:
        return (
            self.features
            + [f"target_{h}h" for h in self.horizons]
            + [f"baseline_{h}h" for h in self.horizons]
        )


def with_calendar_parts(df: DataFrame, *, time_col: str = "datetime") -> DataFrame:
    return df.withColumns(
        {
            "hour_of_day": hour_of(time_col),
            "day_of_week": day_of_week(time_col),
            "is_weekend": is_weekend(time_col).cast("int"),
        }
    )


def forecast_features(
    df: DataFrame,
    *,
    names: FeatureNames = FeatureNames(),
    cell_col: str = "CellID",
    time_col: str = "datetime",
    order: Sequence[str] | None = None,
    grid_size: int = GRID_SIZE,
    unique: bool = False,
    align: str = "rows",
    long_series: bool = False,
) -> DataFrame:
    """Calendar parts, neighbour average, own and neighbour lags, targets and seasonal baselines.

    All shifts share one window: after the neighbour join the panel is sorted once.
    ``align="time"`` shifts by clock hours; ``long_series`` uses the blocked form.
    """
    order = list(order or ([time_col, "_source_file"] if "_source_file" in df.columns else [time_col]))
    panel = with_neighbor_average(df, cell_col=cell_col, time_col=time_col, grid_size=grid_size, unique=unique)
    shifts = {f"lag_{k}h": ("total_activity", k) for k in names.lags}
    shifts[NEIGHBOR_FEATURE] = ("neighbor_avg_activity", 1)
    for h in names.horizons:
        shifts[f"target_{h}h"] = ("total_activity", -h)
        shifts[f"baseline_{h}h"] = ("total_activity", SEASON_HOURS - h)
    if align == "time":
        panel = shift_hours_aligned(panel, shifts, partition=[cell_col], time_col=time_col)
    elif long_series:
        panel = shift_rows_blocked(panel, shifts, partition=[cell_col], order=order)
    else:
        panel = shift_rows(panel, shifts, partition=[cell_col], order=order)
    panel = with_calendar_parts(panel, time_col=time_col)
    return panel.withColumns({f"naive_feature_{h}h": F.col(f"baseline_{h}h") for h in names.horizons})


def complete_rows(df: DataFrame, names: FeatureNames = FeatureNames()) -> DataFrame:
    """Rows that have every required feature, target and baseline."""
    return df.dropna(subset=names.required)


def dropped_share(df: DataFrame, names: FeatureNames = FeatureNames()) -> DataFrame:
    """Number of rows, and number and share of rows that :func:`complete_rows` leaves out, in one pass."""
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in names.required])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_dropped")
    ).withColumn("dropped_share", F.try_divide("n_dropped", "n_rows"))


def add_lag_and_seasonal_features(
    df: DataFrame,
    target: str,
    *,
    time_col: str = "timestamp",
    lags: Sequence[int] = GENERIC_LAGS,
    order: Sequence[str] | None = None,
    partition: Sequence[str] = (),
    block_rows: int = 100_000,
) -> DataFrame:
    """Calendar parts and ``{target}_lag_{k}`` over any frame with a time column.

    A DataFrame has no input order, so ``order`` (default: the time column) defines it and
    must be unique for a deterministic result. Without ``partition`` the lags run over the
    whole frame, in blocks, never in a single task.
    """
    order = list(order or [time_col])
    shifts = {f"{target}_lag_{k}": (target, k) for k in lags}
    shifted = shift_rows_blocked(
        df, shifts, partition=partition, order=order, block_rows=block_rows
    )
    return shifted.withColumns(
        {
            "hour": hour_of(time_col),
            "day_of_week": day_of_week(time_col),
            "is_weekend": is_weekend(time_col).cast("int"),
        }
    )
