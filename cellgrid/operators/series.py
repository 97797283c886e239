"""Row-offset and time-offset shifts over panel series, and order indexes without a global sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

# name -> (column, rows back); a negative number looks ahead.
Shifts = Mapping[str, tuple[str, int]]


_TASK_BITS = 33  # of a monotonically increasing id, the low ones count a task's rows


def ranged(df: DataFrame, order: Sequence[str | Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Stage table of ``df`` with ``_block`` and ``_place``: its range partition in ``order``, and the row's place there; and ``_block, _offset``.

    Rows are sorted once, inside their partition. The offsets are running sums over the partitions' sizes: a row a
    partition is all that meets in one task, and what is broadcast.
    """
    at = F.monotonically_increasing_id()
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), name)
    placed = placed.withColumns(
        {"_block": F.shiftright("_at", _TASK_BITS), "_place": F.col("_at").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))}
    ).drop("_at")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    return placed, sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def range_index(df: DataFrame, order: Sequence[str], *, name: str = "row_index") -> DataFrame:
    """0-based position of each row in ``order``, which should be unique; without sorting everything in one task.

    ``df`` is written out once before (choosing the ranges reads it a second time) and once with its places.
    """
    placed, offsets = ranged(materialise(df, "to-index"), list(order), "indexed")
    return placed.join(F.broadcast(offsets), "_block").select(*df.columns, (F.col("_offset") + F.col("_place")).alias(name))


def count_below(df: DataFrame, value: str, *, name: str = "n_below") -> DataFrame:
    """``df``, a stored table, with the number of rows whose ``value`` is strictly less; rows without a value get NULL and count for none.

    Rows are dealt by ranges of the value, so equal ones are in one partition: ranks inside it, offsets over the partitions.
    """
    order = [F.col(value).asc_nulls_last()]
    placed, offsets = ranged(df, order, "ranked")
    inside = F.rank().over(Window.partitionBy("_block").orderBy(*order)) - 1
    ranked = placed.withColumn("_below", inside).join(F.broadcast(offsets), "_block")
    return ranked.select(*df.columns, F.when(F.col(value).isNotNull(), F.col("_offset") + F.col("_below")).alias(name))


def _shifted(column: str, back: int, window) -> Column:
    return F.lag(column, back).over(window) if back >= 0 else F.lead(column, -back).over(window)


def shift_rows(
    df: DataFrame,
    shifts: Shifts,
    *,
    partition: Sequence[str] = ("CellID",),
    order: Sequence[str] = ("datetime",),
) -> DataFrame:
    """Add columns shifted by a number of rows within each series: one window, one shuffle, one sort.

    A series is sorted in one task. Collapsed activity has one row per cell, time and file, so
    its length is bounded by the calendar (a decade of hours is 87,600 rows) however skewed
    the raw rows were. For series without such a bound use :func:`shift_rows_blocked`.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.select("*", *[_shifted(c, k, window).alias(n) for n, (c, k) in shifts.items()])


def shift_rows_blocked(
    df: DataFrame,
    shifts: Shifts,
    *,
    partition: Sequence[str] = ("CellID",),
    order: Sequence[str] = ("datetime",),
    block_rows: int = 100_000,
) -> DataFrame:
    """As :func:`shift_rows` for series of any length, also for one series over the whole frame.

    Rows are numbered by :func:`range_index` in order of series and time, cut into blocks of ``block_rows`` consecutive
    rows, and the few rows next to a block border are copied to the neighbouring block, so
    every shift finds its value inside one block.
    """
    back = max([k for _, k in shifts.values() if k > 0], default=0)
    ahead = max([-k for _, k in shifts.values() if k < 0], default=0)
    if max(back, ahead) > block_rows:
        raise ValueError("block_rows must be at least the largest shift")
    indexed = range_index(df, [*partition, *order], name="_idx")

    def block(i: Column) -> Column:
        return F.floor(F.greatest(i, F.lit(0)) / block_rows)

    home = block(F.col("_idx"))
    wanted = F.array_distinct(F.array(home, block(F.col("_idx") + back), block(F.col("_idx") - ahead)))
    copies = indexed.select("*", home.alias("_home"), F.explode(wanted).alias("_block"))
    window = Window.partitionBy(*partition, "_block").orderBy("_idx")
    shifted = copies.select("*", *[_shifted(c, k, window).alias(n) for n, (c, k) in shifts.items()])
    return shifted.filter("_block = _home").select(*df.columns, *shifts)


def shift_hours_aligned(
    df: DataFrame,
    shifts: Shifts,
    *,
    partition: Sequence[str] = ("CellID",),
    time_col: str = "datetime",
    tie_break: str | None = None,
) -> DataFrame:
    """Shift by clock hours instead of rows: the value exactly k hours away, NULL where that hour has no row.

    All shifts are range frames over one window specification.
    """
    seconds = F.unix_seconds(F.col(time_col).cast("timestamp"))
    base = Window.partitionBy(*partition).orderBy(seconds)

    def value(column: str, back: int) -> Column:
        frame = base.rangeBetween(-back * 3600, -back * 3600)
        # Of rows with one time: by the tie break, else the greatest value, so that any order gives the same.
        chosen = F.min_by(column, tie_break) if tie_break else F.max(column)
        return chosen.over(frame)

    return df.select("*", *[value(c, k).alias(n) for n, (c, k) in shifts.items()])
