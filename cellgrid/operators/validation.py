"""Checks of a load against patterns that are published for known places."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    CENTRE_CELL,
    CENTRE_MIN_PERCENTILE,
    DAYTIME_HOURS,
    EVENING_HOURS,
    NIGHTLIFE_CELL,
    PASS,
    UNEXPECTED,
    UNIVERSITY_CELL,
    WEAK,
)
from ..functions.scalars import hour_of, is_weekend
from ..session import materialise
from .series import count_below

NO_ROWS = "NO ROWS"
NO_COLUMN = "NO COLUMN"


def _two_means(df: DataFrame, check: str, cell: int, first: Column, second: Column, passed) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(first).alias("a"), F.avg(second).alias("b"))
    return _judged(row, check, cell, passed)


def _judged(row: DataFrame, check: str, cell: int, passed) -> DataFrame:
    """One row of a check from its number of rows ``n`` and its two means ``a`` and ``b``."""
    status = (
        F.when(F.col("n") == 0, NO_ROWS)
        .when(F.coalesce(passed(F.col("a"), F.col("b")), F.lit(False)), PASS)
        .otherwise(UNEXPECTED)
    )
    return row.select(F.lit(check).alias("check"), F.lit(cell).cast("long").alias("cell"), "a", "b", status.alias("status"))


def weekday_weekend_check(
    df: DataFrame, cell: int = UNIVERSITY_CELL, *, cell_col: str = "CellID", time_col: str = "datetime",
    value: str = "total_activity",
) -> DataFrame:
    """a: weekday mean, b: weekend mean; passes when the weekend is lower."""
    weekend = is_weekend(time_col)
    rows = df.filter(F.col(cell_col) == cell)
    return _two_means(
        rows, "weekend_lower", cell, F.when(~weekend, F.col(value)), F.when(weekend, F.col(value)), lambda a, b: b < a
    )


def evening_daytime_check(
    df: DataFrame, cell: int = NIGHTLIFE_CELL, *, cell_col: str = "CellID", time_col: str = "datetime",
    value: str = "internet",
) -> DataFrame:
    """a: daytime mean, b: evening mean; passes when the evening is higher."""
    rows = df.filter(F.col(cell_col) == cell)
    if value not in df.columns:
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        null = F.lit(None).cast("double")
        return n.select(
            F.lit("evening_higher").alias("check"), F.lit(cell).cast("long").alias("cell"),
            null.alias("a"), null.alias("b"), F.when(F.col("n") == 0, NO_ROWS).otherwise(NO_COLUMN).alias("status"),
        )
    hour = hour_of(time_col)
    return _two_means(
        rows, "evening_higher", cell,
        F.when(hour.between(*DAYTIME_HOURS), F.col(value)),
        F.when(hour.between(*EVENING_HOURS), F.col(value)),
        lambda a, b: b > a,
    )


def cell_means(df: DataFrame, *, cell_col: str = "CellID", value: str = "total_activity") -> DataFrame:
    return df.groupBy(cell_col).agg(F.avg(value).alias("mean_value"))


def cell_percentile_ranks(
    df: DataFrame, watched: Mapping[str, int], *, cell_col: str = "CellID", value: str = "total_activity"
) -> DataFrame:
    """For each watched cell with rows: its mean and the share of cells (percent) with a strictly lower mean.

    Every cell mean is compared with the few watched means by one aggregate, so no task ranks all cells.
    """
    means = cell_means(df, cell_col=cell_col, value=value)
    cells = list(watched.values())
    known = means.filter(F.col(cell_col).isin(cells)).agg(
        *[F.max(F.when(F.col(cell_col) == c, F.col("mean_value"))).alias(f"m{i}") for i, c in enumerate(cells)]
    )
    bars = [known.select(f"m{i}").scalar() for i in range(len(cells))]
    shares = means.agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.max(bar).alias(f"m{i}") for i, bar in enumerate(bars)],
        *[(F.avg((F.col("mean_value") < bar).cast("int")) * 100).alias(f"p{i}") for i, bar in enumerate(bars)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("place"), F.lit(c).cast("long").alias("cell"),
                F.col(f"m{i}").alias("mean_value"), F.col(f"p{i}").alias("percentile"),
            )
            for i, (name, c) in enumerate(watched.items())
        ]
    )
    return shares.select(F.inline(rows), "n_cells").filter("mean_value is not null")


def all_cell_percentile_ranks(df: DataFrame, *, cell_col: str = "CellID", value: str = "total_activity") -> DataFrame:
    """Of every cell: its mean, and the share of cells (percent) with a strictly lower mean; cells without values have neither."""
    means = materialise(cell_means(df, cell_col=cell_col, value=value), "cell-means")
    total = means.agg(F.count(F.lit(1))).scalar()
    return count_below(means, "mean_value").select(
        cell_col, "mean_value", (F.col("n_below") / total * 100).alias("percentile"), total.alias("n_cells")
    )


def centre_rank_check(
    df: DataFrame, cell: int = CENTRE_CELL, *, cell_col: str = "CellID", value: str = "total_activity"
) -> DataFrame:
    """a: mean of the cell, b: its percentile among the cell means; passes from the 90th."""
    ranks = cell_percentile_ranks(df, {"centre": cell}, cell_col=cell_col, value=value)
    row = ranks.agg(F.max("mean_value").alias("a"), F.max("percentile").alias("b"))
    status = (
        F.when(F.col("a").isNull(), NO_ROWS).when(F.col("b") >= CENTRE_MIN_PERCENTILE, PASS).otherwise(WEAK)
    )
    return row.select(F.lit("centre_high").alias("check"), F.lit(cell).cast("long").alias("cell"), "a", "b", status.alias("status"))


def known_pattern_report(
    df: DataFrame,
    *,
    university: int = UNIVERSITY_CELL,
    nightlife: int = NIGHTLIFE_CELL,
    centre: int = CENTRE_CELL,
    cell_col: str = "CellID",
    time_col: str = "datetime",
) -> DataFrame:
    """The three checks as rows: check, cell, a, b, status.

    The panel is read once, for a stage table with a row per cell; the checks read that.
    """
    weekend, hour = is_weekend(time_col), hour_of(time_col)
    evening = "internet" in df.columns
    parts = {"weekday": ("total_activity", ~weekend), "weekend": ("total_activity", weekend)}
    if evening:
        parts |= {"day": ("internet", hour.between(*DAYTIME_HOURS)), "evening": ("internet", hour.between(*EVENING_HOURS))}
    facts = materialise(
        df.groupBy(cell_col).agg(
            F.count(F.lit(1)).alias("n"), F.avg("total_activity").alias("mean_value"),
            *[F.avg(F.when(condition, F.col(c))).alias(name) for name, (c, condition) in parts.items()],
        ),
        "cell-facts",
    )

    def means_of(cell: int, a: str, b: str) -> DataFrame:
        own = facts.filter(F.col(cell_col) == cell)
        return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max(a).alias("a"), F.max(b).alias("b"))

    return reduce(
        DataFrame.unionByName,
        [
            _judged(means_of(university, "weekday", "weekend"), "weekend_lower", university, lambda a, b: b < a),
            _judged(means_of(nightlife, "day", "evening"), "evening_higher", nightlife, lambda a, b: b > a)
            if evening else evening_daytime_check(df, nightlife, cell_col=cell_col, time_col=time_col),
            centre_rank_check(facts, centre, cell_col=cell_col, value="mean_value"),
        ],
    )
