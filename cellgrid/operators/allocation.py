"""Hourly reallocation of spare capacity from neighbours to cells with routine congestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import AMOUNT_TOLERANCE, GRID_SIZE, ROUTINE
from ..functions.scalars import excess
from .allocation_rounds import solve
from .neighbors import neighbor_rows


def capacity(
    panel: DataFrame, horizon: int = 1, *, cell_col: str = "CellID", tie_break: str | None = "_source_file"
) -> DataFrame:
    """Forecast, threshold, deficit and spare per (cell, target time); rows without a forecast are left out.

    Where several files give the same cell and time, the last file counts.
    """
    base = panel.select(
        cell_col,
        F.col(f"target_datetime_{horizon}h").alias("target_datetime"),
        F.col(f"naive_forecast_{horizon}h").alias("forecast"),
        "congestion_threshold",
        *([tie_break] if tie_break and tie_break in panel.columns else []),
    ).filter("forecast is not null")
    if tie_break and tie_break in base.columns:
        base = base.groupBy(cell_col, "target_datetime").agg(
            F.max_by(F.struct("forecast", "congestion_threshold"), tie_break).alias("_last")
        ).select(cell_col, "target_datetime", "_last.forecast", "_last.congestion_threshold")
    return base.withColumns(
        {
            "deficit": excess("forecast", "congestion_threshold"),
            "spare": excess("congestion_threshold", "forecast"),
        }
    )


def routine_cases(diagnosed: DataFrame, horizon: int = 1, *, cell_col: str = "CellID") -> DataFrame:
    """The routine cases of a diagnosis as (cell, target_datetime, deficit), one per key."""
    routine = diagnosed.filter(F.col("classification") == ROUTINE).select(
        cell_col,
        F.col(f"target_datetime_{horizon}h").alias("target_datetime"),
        F.struct(
            *(["_source_file"] if "_source_file" in diagnosed.columns else []),
            excess(f"naive_forecast_{horizon}h", "congestion_threshold").alias("deficit"),
        ).alias("_case"),
    )
    return (
        routine.groupBy(cell_col, "target_datetime").agg(F.max("_case").alias("_case"))
        .select(cell_col, "target_datetime", "_case.deficit")
    )


def candidate_edges(
    cases: DataFrame, spare: DataFrame, *, cell_col: str = "CellID", grid_size: int = GRID_SIZE
) -> DataFrame:
    """Case x neighbour pairs where the neighbour has spare capacity at the case's time.

    Columns: target_datetime, congested_cell, deficit, pos, source_cell, spare.
    """
    offers = spare.filter("spare > 0").select(
        F.col(cell_col).alias("source_cell"), "target_datetime", "spare"
    )
    wanted = neighbor_rows(cases, cell_col=cell_col, grid_size=grid_size).select(
        "target_datetime", F.col(cell_col).alias("congested_cell"), "deficit", "pos",
        F.col("neighbor").alias("source_cell"),
    )
    return wanted.join(offers, ["source_cell", "target_datetime"]).select(
        "target_datetime", "congested_cell", "deficit", "pos", "source_cell", "spare"
    )


def moves_of(plan: DataFrame) -> DataFrame:
    """Reallocation table: one row per (hour, case, source) with the amount moved."""
    return plan.filter("kind = 'move'").select(
        "target_datetime", "congested_cell", "source_cell", F.col("amount").alias("amount_moved")
    )


def allocate(edges: DataFrame) -> DataFrame:
    """Reallocation table of a best plan, the same method at every size of the grid or of an hour."""
    return moves_of(solve(edges))


def coverage(cases: DataFrame, moves: DataFrame, *, cell_col: str = "CellID") -> DataFrame:
    """Per routine case: deficit, amount covered (0 if none) and whether that resolves it."""
    covered = moves.groupBy(F.col("congested_cell").alias(cell_col), "target_datetime").agg(
        F.sum("amount_moved").alias("covered")
    )
    joined = cases.join(covered, [cell_col, "target_datetime"], "left")
    joined = joined.withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    return joined.select(
        cell_col, "target_datetime", "deficit", "covered",
        (F.col("covered") >= F.col("deficit") - AMOUNT_TOLERANCE).alias("fully_resolved"),
    )


def coverage_totals(covered: DataFrame) -> DataFrame:
    """Totals over all cases: needed, covered, rate, fully resolved count and share, cases and hours."""
    sums = covered.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_distinct("target_datetime").alias("n_hours"),
        F.coalesce(F.sum("deficit"), F.lit(0.0)).alias("total_deficit"),
        F.coalesce(F.sum("covered"), F.lit(0.0)).alias("total_covered"),
        F.count_if("fully_resolved").alias("n_resolved"),
    )
    return sums.withColumns(
        {
            "coverage_rate": F.try_divide("total_covered", "total_deficit"),
            "resolved_share": F.try_divide("n_resolved", "n_cases"),
        }
    )


def plan_check(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Per hour: amount moved, capacity of the proving cut, and how far any case or source is overdrawn."""
    moves = moves_of(plan)
    per_case = edges.groupBy("target_datetime", "congested_cell").agg(F.max("deficit").alias("bound"))
    per_source = edges.groupBy("target_datetime", "source_cell").agg(F.max("spare").alias("bound"))

    def overdrawn(bounds: DataFrame, key: str, name: str) -> DataFrame:
        used = moves.groupBy("target_datetime", key).agg(F.sum("amount_moved").alias("used"))
        return (
            bounds.join(used, ["target_datetime", key], "left")
            .groupBy("target_datetime")
            .agg(F.count_if(F.coalesce("used", F.lit(0.0)) > F.col("bound") + AMOUNT_TOLERANCE).alias(name))
        )

    totals = plan.groupBy("target_datetime").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "move", F.col("amount"))), F.lit(0.0)).alias("moved"),
        F.coalesce(F.sum(F.when(F.col("kind") == "cut", F.col("amount"))), F.lit(0.0)).alias("cut_capacity"),
    )
    return totals.join(overdrawn(per_case, "congested_cell", "cases_overdrawn"), "target_datetime").join(
        overdrawn(per_source, "source_cell", "sources_overdrawn"), "target_datetime"
    )
