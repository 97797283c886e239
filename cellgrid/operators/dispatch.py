"""Two elementary checks: supply shortfall and forecast residual."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shortfall(demand: Column | str, supply: Column | str) -> Column:
    """Unmet demand, never negative."""
    d, s = (F.col(c) if isinstance(c, str) else c for c in (demand, supply))
    return F.greatest(d - s, F.lit(0))


def array_shortfall(demand: Column | str, supply: Column | str) -> Column:
    """Element-wise :func:`shortfall` of two arrays."""
    return F.zip_with(demand, supply, shortfall)


def residual_status(forecast: Column | str, actual: Column | str, threshold: Column | str) -> Column:
    """``ok`` when forecast and actual differ by at most the threshold, else ``deviation``."""
    f, a, t = (F.col(c) if isinstance(c, str) else c for c in (forecast, actual, threshold))
    return F.when(F.abs(a - f) <= t, F.lit("ok")).otherwise(F.lit("deviation"))
