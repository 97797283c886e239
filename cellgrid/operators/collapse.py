"""Raw call-detail rows to one row per cell, time and file, and the load's quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import ACTIVITY_COLUMNS, SAMPLE_ROWS

SOURCE = "_source_file"


def collapse_country_codes(
    raw: DataFrame,
    *,
    cell_col: str = "CellID",
    time_col: str = "datetime",
    activities: Sequence[str] = ACTIVITY_COLUMNS,
    with_raw_count: bool = False,
) -> DataFrame:
    """Sum each activity over country codes, per (cell, time, file); rows without a key are left out.

    The sums combine map-side, so a cell or file that holds a large share of the raw
    rows reaches the shuffle as at most one row per key and task.
    """
    sums = [F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in activities if a in raw.columns]
    if with_raw_count:
        sums.append(F.count(F.lit(1)).alias("raw_rows"))
    keyed = raw.filter(F.col(cell_col).isNotNull() & F.col(time_col).isNotNull())
    return keyed.groupBy(cell_col, time_col, SOURCE).agg(*sums)


def collapse_counts(
    raw: DataFrame, *, cell_col: str = "CellID", time_col: str = "datetime"
) -> DataFrame:
    """Raw and collapsed row counts per file. Rows without a key count as raw only."""
    per_key = raw.groupBy(SOURCE, cell_col, time_col).agg(F.count(F.lit(1)).alias("n"))
    has_key = F.col(cell_col).isNotNull() & F.col(time_col).isNotNull()
    return per_key.groupBy(SOURCE).agg(
        F.sum("n").alias("raw_rows"), F.count_if(has_key).alias("collapsed_rows")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """One row per column with its number of missing values, from one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing")


def overview(df: DataFrame, *, cell_col: str = "CellID", time_col: str = "datetime") -> DataFrame:
    """Row and column count, time range and number of distinct cells, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.min(time_col).alias("first_time"),
        F.max(time_col).alias("last_time"),
        F.count_distinct(cell_col).alias("n_cells"),
    )


def sampling_step(df: DataFrame, *, time_col: str = "datetime") -> DataFrame:
    """Most frequent difference between consecutive distinct times, in seconds; the smallest one on a tie.

    Differences are taken within days, and between days on the table of daily first and
    last times, so no task sorts more than the distinct times of one day.
    """
    times = df.select(F.col(time_col).alias("t")).filter("t is not null").distinct()
    times = times.withColumn("day", F.to_date("t"))
    ordered = Window.partitionBy("day").orderBy("t")
    inside = times.select("t", F.lag("t").over(ordered).alias("before")).filter("before is not null")
    # One row per calendar day: a century is 36,525 rows.
    days = times.groupBy("day").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    across = days.select(
        F.col("first_t").alias("t"), F.lag("last_t").over(Window.orderBy("day")).alias("before")
    ).filter("before is not null")
    seconds = inside.unionByName(across).select(
        ((F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6)
        .alias("step_seconds")
    )
    counts = seconds.groupBy("step_seconds").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "step_seconds").limit(1)


def sample_rows(df: DataFrame, order: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by an explicit key."""
    return df.orderBy(*order).limit(n)


def rejected_rows(raw: DataFrame, *, cell_col: str = "CellID", time_col: str = "datetime") -> DataFrame:
    """Per file, the raw rows left out because the cell is no whole number or the time is missing."""
    return raw.groupBy(SOURCE).agg(
        F.count_if(F.col(cell_col).isNull()).alias("without_cell"), F.count_if(F.col(time_col).isNull()).alias("without_time")
    )


def quality_report(
    raw: DataFrame, collapsed: DataFrame, *, cell_col: str = "CellID", time_col: str = "datetime"
) -> dict[str, DataFrame]:
    """All quality tables of a load. ``collapsed`` has a normalised time column."""
    keys = [cell_col, time_col, SOURCE]
    return {
        "files": collapse_counts(raw, cell_col=cell_col, time_col=time_col),
        "rejected": rejected_rows(raw, cell_col=cell_col, time_col=time_col),
        "missing": missing_profile(collapsed),
        "overview": overview(collapsed, cell_col=cell_col, time_col=time_col),
        "sampling_step": sampling_step(collapsed, time_col=time_col),
        "sample": sample_rows(collapsed, keys),
    }
