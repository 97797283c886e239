"""Exact interpolated quantiles per group without gathering or sorting a whole group.

Two passes. The first builds a mergeable quantile sketch per group (map-side), whose rank
error is at most ``1/accuracy`` of the group, and takes from it two values that bracket the
wanted rank. The second counts the values below the bracket (also map-side) and keeps the
distinct values inside it with their counts; only those are sorted, so a group that holds a
large share of all rows sends a small fraction of itself to one task. The result is exact:
ranks are counted, never estimated.

The per-group table between the passes is written out as a small stage table: the planner then
knows its real size and, as long as that is below the broadcast limit, sends it to the rows
instead of shuffling the rows to it. Above the limit it is an ordinary join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .series import ranged

# Fractions known only at run time are bracketed on a grid of this many steps.
_STEPS = 1000


def interpolate(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation, taken from the nearer end so that both ends are hit exactly."""
    width = high - low
    return F.when(part >= 0.5, high - width * (1 - part)).otherwise(low + width * part)


def _rank_slack(n: Column, accuracy: int) -> Column:
    """How far, as a fraction, a sketched value may be from the wanted order statistics:
    the sketch's rank error plus two ranks for rounding and for the upper neighbour."""
    return F.lit(1.0 / accuracy) + F.lit(2.0) / n


def _margins(accuracy: int) -> list[float]:
    return [4.0 * 10**k / accuracy for k in range(6) if 4.0 * 10**k / accuracy < 0.5]


def _pivots(value: str, fraction: float, accuracy: int) -> Column:
    """Sketched values at every margin below and above ``fraction``, from one sketch."""
    wanted = [min(max(fraction + sign * m, 0.0), 1.0) for sign in (-1, 1) for m in _margins(accuracy)]
    return F.percentile_approx(value, F.array(*[F.lit(w) for w in wanted]), F.lit(accuracy))


def _choose_margin(pivots: Column, n: Column, fraction: float, sign: int, accuracy: int) -> Column:
    """The value at the narrowest sufficient margin; NULL (open side) when the group is too small for one."""
    margins = _margins(accuracy)
    first = 0 if sign < 0 else len(margins)
    chosen = F.lit(None).cast("double")
    for i, margin in reversed(list(enumerate(margins))):
        if 0.0 < fraction + sign * margin < 1.0:
            chosen = F.when(_rank_slack(n, accuracy) <= margin, F.get(pivots, F.lit(first + i))).otherwise(chosen)
    return chosen


def _grid_bracket(grid: Column, fraction: Column, n: Column, accuracy: int) -> tuple[Column, Column]:
    slack = _rank_slack(n, accuracy)
    below = F.floor((fraction - slack) * _STEPS).cast("int")
    above = F.ceil((fraction + slack) * _STEPS).cast("int")
    return F.when(below >= 1, F.get(grid, below)), F.when(above < _STEPS, F.get(grid, above))


def pick_ranks(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Second pass. ``stats`` holds keys, n, fraction, low, high, and columns to carry along; one row per group."""
    carried = [c for c in stats.columns if c not in {*keys, "n", "fraction", "low", "high"}]
    stats = materialise(stats, "group-stats")
    joined = df.select(*keys, F.col(value).alias("v")).filter("v is not null").join(stats, list(keys))
    low, high = F.col("low"), F.col("high")
    inside_or_below = joined.filter(high.isNull() | (F.col("v") <= high))
    # NULL stands for "below the bracket": one row per group and task after map-side counting.
    binned = inside_or_below.select(
        *keys, F.when(low.isNull() | (F.col("v") >= low), F.col("v")).alias("v"), "n", "fraction", *carried
    )
    counts = binned.groupBy(*keys, "n", "fraction", *carried, "v").agg(F.count(F.lit(1)).alias("c"))
    running = (
        Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.col("fraction") * (F.col("n") - 1)
    ranked = counts.withColumn("upto", F.sum("c").over(running)).withColumn("position", position)

    def at(rank: Column) -> Column:
        here = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
        return F.max(F.when(here & F.col("v").isNotNull(), F.col("v")))

    picked = ranked.groupBy(*keys).agg(
        at(F.floor("position")).alias("v_low"),
        at(F.ceil("position")).alias("v_high"),
        F.max(F.col("position") - F.floor("position")).alias("part"),
        *[F.max(c).alias(c) for c in carried],
    )
    missed = F.col("v_low").isNull() | F.col("v_high").isNull()
    quantile = interpolate(F.col("v_low"), F.col("v_high"), F.col("part"))
    checked = F.when(missed, F.raise_error(F.lit("rank outside the sketched bracket")).cast("double")).otherwise(quantile)
    return picked.select(*keys, checked.alias("quantile"), *carried)


def group_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fraction: float,
    *,
    accuracy: int = 10000,
    sketch: bool = True,
) -> DataFrame:
    """Quantile of ``value`` per group: ``keys``, ``quantile``. Missing values are skipped.

    ``sketch=False`` uses Spark's ``percentile`` instead: one pass, but a group's distinct
    values meet in one task, so it is for groups of known small size.
    """
    present = df.filter(F.col(value).isNotNull())
    if not sketch:
        return present.groupBy(*keys).agg(F.percentile(value, F.lit(fraction)).alias("quantile"))
    pivots = _pivots(value, fraction, accuracy)
    stats = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pivots.alias("pivots")).select(
        *keys, "n", F.lit(float(fraction)).alias("fraction"),
        _choose_margin(F.col("pivots"), F.col("n"), fraction, -1, accuracy).alias("low"),
        _choose_margin(F.col("pivots"), F.col("n"), fraction, 1, accuracy).alias("high"),
    )
    return pick_ranks(present, stats, keys, value)


def mean_to_max_quantile(
    df: DataFrame, keys: Sequence[str], value: str, *, accuracy: int = 10000
) -> DataFrame:
    """Quantile of ``value`` at the group's own fraction ``1 - mean/max``, clamped to [0, 1].

    Returns keys, ``threshold``, ``f_star``. A flat or all-zero group gets its maximum and 1.
    """
    present = df.filter(F.col(value).isNotNull())
    grid = F.percentile_approx(
        value, F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)]), F.lit(accuracy)
    )
    base = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_v"), F.max(value).alias("max_v"), grid.alias("grid")
    )
    flat = (F.col("max_v") == 0) | (F.col("mean_v") == F.col("max_v"))
    share = F.lit(1.0) - F.try_divide(F.col("mean_v"), F.col("max_v"))
    f_star = F.when(flat, F.lit(1.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    base = base.withColumn("f_star", f_star)
    low, high = _grid_bracket(F.col("grid"), F.col("f_star"), F.col("n"), accuracy)
    # The grid stays in this stage: only two values per group travel on. A flat group's
    # quantile at 1 is its maximum, which is the wanted value.
    stats = base.select(
        *keys, "n", "f_star", ((F.col("f_star") * 100) / 100).alias("fraction"), low.alias("low"), high.alias("high")
    )
    return pick_ranks(present, stats, keys, value).withColumnRenamed("quantile", "threshold")


def whole_quantiles(df: DataFrame, value: str, fractions: Sequence[float], *, weight: str | None = None) -> DataFrame:
    """One row ``q0, q1, ..``: quantiles of ``value`` over all rows, each counting ``weight`` times (a whole number, default once).

    Equal values are added up, the rest is dealt by ranges of the value. Weight sums of the ranges tell which
    of them hold the wanted ranks, and only those few are summed value by value. NULL without any weight; missing values are skipped.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = materialise(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(n.alias("w")).filter("w > 0"), "values")
    placed, _ = ranged(values, ["v"], "ranged-values")
    sums = placed.groupBy("_block").agg(F.sum("w").alias("w"))  # a row a partition
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "_block", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"), F.sum("w").over(Window.partitionBy()).alias("total")
    )
    positions = [F.lit(float(f)) * (F.col("total") - 1) for f in fractions]
    ranks = [r for p in positions for r in (F.floor(p), F.ceil(p))]

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (F.col("before") + F.col("w") > rank)

    wanted = sums.filter(reduce(lambda a, b: a | b, map(holds, ranks))).drop("w")
    running = Window.partitionBy("_block").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.join(F.broadcast(wanted), "_block")
    inside = inside.withColumn("before", F.col("before") + F.sum("w").over(running) - F.col("w"))
    picked = inside.agg(
        F.max("total").alias("total"), *[F.max(F.when(holds(r), F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)]
    )
    return picked.select(
        *[interpolate(F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}"), p - F.floor(p)).alias(f"q{i}") for i, p in enumerate(positions)]
    )
