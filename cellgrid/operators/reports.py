"""Plain-language case reports from fixed templates, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import (
    GRID_SIZE,
    REPORT_ANOMALOUS,
    REPORT_NO_SOURCE,
    REPORT_ROUTINE,
    REPORT_SOURCE,
    ROUTINE,
    SAMPLES_PER_CLASS,
    TIME_FORMAT,
)
from ..functions.grid import cell_x, cell_y
from ..functions.scalars import fill_template, fixed_decimals
from .series import range_index

SOURCES_TYPE = "array<struct<source:bigint,amount:double>>"


def nest_sources(moves: DataFrame, *, cell_col: str = "CellID", grid_size: int = GRID_SIZE) -> DataFrame:
    """Per case the array of (source, amount) in neighbour order. A case has at most eight sources."""
    dx = cell_x("source_cell", grid_size) - cell_x("congested_cell", grid_size)
    dy = cell_y("source_cell", grid_size) - cell_y("congested_cell", grid_size)
    entry = F.struct(dx.alias("dx"), dy.alias("dy"), F.col("source_cell").alias("source"), F.col("amount_moved").alias("amount"))
    nested = moves.groupBy(F.col("congested_cell").alias(cell_col), "target_datetime").agg(
        F.sort_array(F.collect_list(entry)).alias("_s")
    )
    plain = F.transform("_s", lambda s: F.struct(s["source"].alias("source"), s["amount"].alias("amount")))
    return nested.select(cell_col, "target_datetime", plain.alias("sources"))


def assemble_cases(
    diagnosed: DataFrame,
    covered: DataFrame | None,
    moves: DataFrame | None,
    *,
    horizon: int = 1,
    cell_col: str = "CellID",
    grid_size: int = GRID_SIZE,
) -> DataFrame:
    """Diagnosed rows with coverage and the nested sources (an empty array where there are none)."""
    key = [cell_col, "target_datetime"]
    cases = diagnosed.withColumnRenamed(f"target_datetime_{horizon}h", "target_datetime")
    if covered is not None:
        cases = cases.join(covered.select(*key, "deficit", "covered", "fully_resolved"), key, "left")
    else:
        cases = cases.withColumns(
            {"deficit": F.lit(None).cast("double"), "covered": F.lit(None).cast("double"),
             "fully_resolved": F.lit(None).cast("boolean")}
        )
    if moves is None:
        return cases.withColumn("sources", F.array().cast(SOURCES_TYPE))
    cases = cases.join(nest_sources(moves, cell_col=cell_col, grid_size=grid_size), key, "left")
    return cases.withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES_TYPE)))


def time_text(ts: Column | str) -> Column:
    return F.date_format(ts, TIME_FORMAT)


def report_text(
    *,
    cell: str = "CellID",
    time: str = "target_datetime",
    classification: str = "classification",
    reason: str = "reason",
    deficit: str = "deficit",
    covered: str = "covered",
    sources: str = "sources",
) -> Column:
    """Routine cases get the routine template, all others the escalation."""
    listed = F.array_join(
        F.transform(
            sources,
            lambda s: fill_template(REPORT_SOURCE, amount=fixed_decimals(s["amount"], 1), source=s["source"]),
        ),
        ", ",
    )
    action = F.when(F.size(sources) > 0, listed).otherwise(REPORT_NO_SOURCE)
    pct = F.coalesce(
        F.try_divide(F.coalesce(F.col(covered), F.lit(0.0)), F.col(deficit)) * 100, F.lit(0.0)
    )
    common = {"cell": F.col(cell), "time": time_text(time), "reason": F.col(reason)}
    routine = fill_template(REPORT_ROUTINE, action=action, pct=fixed_decimals(pct, 0), **common)
    return F.when(F.col(classification) == ROUTINE, routine).otherwise(fill_template(REPORT_ANOMALOUS, **common))


def with_reports(cases: DataFrame, **columns: str) -> DataFrame:
    return cases.withColumn("report", report_text(**columns))


def first_per_class(
    cases: DataFrame, n: int = SAMPLES_PER_CLASS, *, cell_col: str = "CellID", time_col: str = "target_datetime"
) -> DataFrame:
    """The first ``n`` cases of each class by cell and time.

    The rank filter becomes a group limit ahead of the exchange: each task passes on at most
    ``n`` rows per class, so no task sorts a whole class.
    """
    order = Window.partitionBy("classification").orderBy(cell_col, time_col)
    ranked = cases.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def upsert_reports(
    existing: DataFrame, generated: DataFrame, *, now: Column | None = None, refresh: bool = False, last_id: int | None = None
) -> DataFrame:
    """Merge ``generated`` (case_id, report_text) into ``existing`` (id, case_id, report_text, generated_at).

    An existing report gets the new text and keeps its time (``refresh`` renews it); a new
    one gets ``now`` and the next free id (after ``last_id``, by default the greatest there is), in case order.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    new = generated.select("case_id", F.col("report_text").alias("_text"))
    merged = existing.join(new, "case_id", "full_outer")
    stamp = F.when(F.lit(refresh) & F.col("_text").isNotNull(), now).otherwise(F.coalesce("generated_at", now))
    kept = merged.filter("id is not null").select(
        "id", "case_id", F.coalesce("_text", "report_text").alias("report_text"), stamp.alias("generated_at")
    )
    fresh = range_index(merged.filter("id is null").select("case_id", "_text"), ["case_id"])
    last = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0)) if last_id is None else F.lit(last_id)
    inserted = fresh.select(
        (last + F.col("row_index") + 1).alias("id"), "case_id", F.col("_text").alias("report_text"),
        now.alias("generated_at"),
    )
    return kept.unionByName(inserted)
