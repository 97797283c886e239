"""Congestion thresholds per group and the flags and summaries built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import CONGESTION_PERCENTILE
from ..functions.scalars import exceeds
from ..session import materialise
from .quantiles import group_quantile, mean_to_max_quantile, whole_quantiles


def percentile_thresholds(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("CellID",),
    value: str = "total_activity",
    percentile: float = CONGESTION_PERCENTILE,
    as_of=None,
    time_col: str = "datetime",
    sketch: bool = True,
) -> DataFrame:
    """Per-group percentile: keys, ``congestion_threshold``. ``as_of`` limits the history to earlier times."""
    history = df if as_of is None else df.filter(F.col(time_col) < F.lit(as_of).cast("timestamp_ntz"))
    found = group_quantile(history, keys, value, percentile / 100, sketch=sketch)
    return found.withColumnRenamed("quantile", "congestion_threshold")


def flag_congestion(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("CellID",),
    value: str = "total_activity",
    percentile: float = CONGESTION_PERCENTILE,
    thresholds: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Attach the threshold and the strict flag. One threshold row per group, so the join never
    multiplies rows. The thresholds are staged, so that the planner sees their size: it broadcasts
    them below its limit, and otherwise joins by shuffle with skewed groups split."""
    if thresholds is None:
        found = percentile_thresholds(df, keys=keys, value=value, percentile=percentile, **options)
        thresholds = materialise(found, "thresholds")
    return df.join(thresholds, list(keys), "left").withColumn(
        "is_congestion_risk", exceeds(value, "congestion_threshold")
    )


def mean_to_max_thresholds(
    df: DataFrame, *, keys: Sequence[str] = ("CellID",), value: str = "total_activity"
) -> DataFrame:
    """Thresholds of the mean-to-max rule: keys, ``loubar_threshold``, ``loubar_f_star``.

    ``keys=("CellID",)`` compares a cell with its own history, ``keys=("datetime",)`` the
    cells with each other at one time (spatial hotspots).
    """
    found = mean_to_max_quantile(df, keys, value)
    return found.select(
        *keys, F.col("threshold").alias("loubar_threshold"), F.col("f_star").alias("loubar_f_star")
    )


def flag_mean_to_max(
    df: DataFrame, *, keys: Sequence[str] = ("CellID",), value: str = "total_activity"
) -> DataFrame:
    thresholds = materialise(mean_to_max_thresholds(df, keys=keys, value=value), "thresholds")
    return df.join(thresholds, list(keys), "left").withColumn(
        "is_congestion_risk", exceeds(value, "loubar_threshold")
    )


def describe_groups(per_group: DataFrame, value: str = "loubar_f_star") -> DataFrame:
    """count, mean, std, min, quartiles and max over a table that has one row per group."""
    quarters = whole_quantiles(per_group, value, (0.25, 0.5, 0.75))
    p25, p50, p75 = (quarters.select(f"q{i}").scalar() for i in range(3))
    return per_group.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).select("count", "mean", "std", "min", p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "max")


def one_row_per_cell(df: DataFrame, columns: Sequence[str], *, cell_col: str = "CellID") -> DataFrame:
    """Per-cell values that were attached to every row, back to one row per cell."""
    return df.select(cell_col, *columns).dropDuplicates([cell_col])


def flag_rate(df: DataFrame, *, cell_col: str = "CellID", flag: str = "is_congestion_risk") -> DataFrame:
    """Number of cells and share of flagged rows in percent, as one row."""
    return df.agg(
        F.count_distinct(cell_col).alias("n_cells"),
        (F.avg(F.col(flag).cast("int")) * 100).alias("flagged_pct"),
    )


def watched_flag_rates(
    df: DataFrame,
    watched: Mapping[str, int],
    *,
    cell_col: str = "CellID",
    flag: str = "is_congestion_risk",
    columns: Sequence[str] = ("congestion_threshold",),
) -> DataFrame:
    """Share of flagged rows and the attached per-cell columns, for the named cells that have rows."""
    names = F.create_map(*[F.lit(x) for name, cell in watched.items() for x in (cell, name)])
    rates = (
        df.filter(F.col(cell_col).isin(list(watched.values())))
        .groupBy(cell_col)
        .agg(
            *[F.max(c).alias(c) for c in columns],
            (F.avg(F.col(flag).cast("int")) * 100).alias("flagged_pct"),
        )
    )
    return rates.withColumn("place", names[F.col(cell_col).cast("int")])
