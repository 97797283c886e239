"""Row-level expressions. Missing values are NULL throughout; NaN never enters a comparison."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import ACTIVITY_COLUMNS, SEASON_HOURS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes NULL."""
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def to_cell(c: Column | str) -> Column:
    """Text or number to a whole cell number; NULL where it is none (``nan``, ``1.7``, blank, out of range)."""
    exact = _col(c).try_cast("bigint")
    number = _col(c).try_cast("double")
    whole = (F.abs(number) < float(1 << 53)) & (number == F.rint(number))
    text = _col(c).cast("string")
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), exact).otherwise(F.when(whole, number).try_cast("bigint"))


def present_activities(df: DataFrame, names: Sequence[str] = ACTIVITY_COLUMNS) -> list[str]:
    return [n for n in names if n in df.columns]


def total_activity(columns: Iterable[str]) -> Column:
    """Row sum that skips missing values (all missing gives 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def with_total_activity(df: DataFrame, *, only_if_absent: bool = False) -> DataFrame:
    if only_if_absent and "total_activity" in df.columns:
        return df
    columns = present_activities(df)
    if not columns:
        raise ValueError(f"none of {list(ACTIVITY_COLUMNS)} in {df.columns}")
    return df.withColumn("total_activity", total_activity(columns))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def day_of_week(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(ts))


def is_weekend(ts: Column | str) -> Column:
    return day_of_week(ts) >= 5


def shift_hours(ts: Column | str, hours: int) -> Column:
    return _col(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def hour_key(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def date_key(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def source_date(target_ts: Column | str) -> Column:
    """Date the seasonal forecast for ``target_ts`` was copied from."""
    return F.to_date(shift_hours(target_ts, -SEASON_HOURS))


def exceeds(value: Column | str, threshold: Column | str) -> Column:
    """Strictly greater; a missing side is False."""
    return F.coalesce(_col(value) > _col(threshold), F.lit(False))


def excess(value: Column | str, bound: Column | str) -> Column:
    """``value - bound`` where positive, else 0. Filter missing values first: NULL would become 0."""
    return F.greatest(_col(value) - _col(bound), F.lit(0.0))


def log_scale(c: Column | str) -> Column:
    return F.log1p(_col(c))


def from_log_scale(c: Column | str) -> Column:
    """Inverse of :func:`log_scale`, never negative."""
    return F.greatest(F.expm1(_col(c)), F.lit(0.0))


def at_least(c: Column | str, floor: float = 1.0) -> Column:
    return F.greatest(_col(c), F.lit(float(floor)))


def fixed_decimals(c: Column | str, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded half-even on the exact binary value, without grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", _col(c), F.lit(pattern))


def round_binary(c: Column | str, digits: int) -> Column:
    """Double rounded half-even on its exact binary value."""
    return fixed_decimals(c, digits).cast("double")


def fill_template(template: str, **parts: Column) -> Column:
    """Concatenate the literal pieces of ``template`` with columns in place of ``{name}``."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        literal, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if literal:
            pieces.append(F.lit(literal))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)
