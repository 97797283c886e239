"""Thresholds that need no rescan: a quantile sketch per (cell, day), stored, and merged over any window of days.

A day is read once, when it comes. The threshold of any later window merges the sketches of its days, one row a cell and day
whatever the number of raw rows. The sketch bounds the rank error; where exact thresholds are wanted, the merged
sketch gives the bracket and one pass over the window's rows counts the ranks inside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import CONGESTION_PERCENTILE
from .quantiles import pick_ranks

SKETCH_SIZE = 400
DAY = "day"


def rank_error(size: int) -> float:
    """Bound of the rank error, as a share of the rows, of a sketch of this size: twice what 99 of 100 sketches keep to."""
    return 2 * 2.296 / size**0.9021


class ThresholdState:
    """Stored sketches under ``path``, a folder a day: keys, ``n`` (values) and ``sketch``. A day that is added again replaces the old one."""

    def __init__(
        self, spark: SparkSession, path: str, *, keys: Sequence[str] = ("CellID",), value: str = "total_activity", time_col: str = "datetime",
        size: int = SKETCH_SIZE,
    ):
        self.spark, self.path, self.keys, self.value, self.time_col, self.size = spark, path, list(keys), value, time_col, size

    def _day(self) -> Column:
        return F.to_date(self.time_col)

    def add(self, rows: DataFrame) -> None:
        """Sketch the days of ``rows``, whole days each. Missing values are skipped; rows without time are left out."""
        present = rows.where(F.col(self.value).isNotNull() & F.col(self.time_col).isNotNull())
        made = present.groupBy(*self.keys, self._day().alias(DAY)).agg(
            F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(self.value).cast("double"), self.size).alias("sketch")
        )
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path)

    def days(self) -> DataFrame | None:
        """The stored rows, or None before the first day."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):
                return None
            raise

    def merged(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """``keys, n, sketch`` of the days from ``first`` to ``last``, both included; only these folders are read."""
        stored = self.days()
        if stored is None:
            raise ValueError(f"no days in {self.path}")
        if first is not None:
            stored = stored.where(F.col(DAY) >= F.lit(first))
        if last is not None:
            stored = stored.where(F.col(DAY) <= F.lit(last))
        return stored.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))

    def thresholds(self, first: date | None = None, last: date | None = None, *, percentile: float = CONGESTION_PERCENTILE) -> DataFrame:
        """``keys, n, congestion_threshold`` from the sketches alone: a value of the data whose rank is off by at most ``rank_error``."""
        at = F.kll_sketch_get_quantile_double("sketch", F.lit(percentile / 100))
        return self.merged(first, last).select(*self.keys, "n", at.alias("congestion_threshold"))

    def exact_thresholds(
        self, rows: DataFrame, first: date | None = None, last: date | None = None, *, percentile: float = CONGESTION_PERCENTILE
    ) -> DataFrame:
        """``keys, congestion_threshold``, exact: ``rows`` must hold what was added for these days, and is read once."""
        # A margin of twice the sketch's error holds two more ranks, for rounding and the upper neighbour, unless a group is small.
        fraction, margin = percentile / 100, 2 * rank_error(self.size)
        large = F.col("n") * rank_error(self.size) >= 2

        def bar(at: float) -> Column:
            return F.when(large, F.kll_sketch_get_quantile_double("sketch", F.lit(at))) if 0 < at < 1 else F.lit(None).cast("double")

        stats = self.merged(first, last).select(
            *self.keys, "n", F.lit(fraction).alias("fraction"), bar(fraction - margin).alias("low"), bar(fraction + margin).alias("high")
        )
        window = rows.where(F.col(self.time_col).isNotNull())
        if first is not None:
            window = window.where(self._day() >= F.lit(first))
        if last is not None:
            window = window.where(self._day() <= F.lit(last))
        return pick_ranks(window, stats, self.keys, self.value).withColumnRenamed("quantile", "congestion_threshold")


def threshold_errors(
    rows: DataFrame, thresholds: DataFrame, *, keys: Sequence[str] = ("CellID",), value: str = "total_activity",
    percentile: float = CONGESTION_PERCENTILE,
) -> DataFrame:
    """``keys, n, rank_error``: counted over ``rows``, how far, as a share of a group's values, a threshold's rank is from the wanted one."""
    bar, v = F.col("congestion_threshold"), F.col(value)
    counted = rows.where(v.isNotNull()).join(thresholds.select(*keys, "congestion_threshold"), list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((v < bar).cast("int")).alias("below"), F.avg((v <= bar).cast("int")).alias("upto"),
    )
    wanted = F.lit(percentile / 100)
    return counted.select(*keys, "n", F.greatest(F.col("below") - wanted, wanted - F.col("upto"), F.lit(0.0)).alias("rank_error"))
