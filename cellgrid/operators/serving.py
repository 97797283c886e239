"""Serving tables (cases, sources, reports) and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import CASE_LABEL, DEFAULT_CASE_LIMIT, GRID_SIZE
from ..functions.grid import cell_x, cell_y
from ..functions.scalars import fill_template, round_binary
from ..session import materialise
from .reports import report_text, time_text
from .series import range_index

REPORTS_SCHEMA = "id long, case_id long, report_text string, generated_at timestamp_ntz"


def build_cases(
    diagnosed: DataFrame,
    covered: DataFrame | None = None,
    *,
    horizon: int = 1,
    cell_col: str = "CellID",
    tie_break: str = "_source_file",
) -> DataFrame:
    """Case table with dense ids from 1 in (cell, time) order.

    (cell, time) is the key of the serving tables: where several files give the same case,
    the last file counts. A missing forecast or threshold becomes 0.
    """
    case = diagnosed.select(
        F.col(cell_col).alias("cell_id"),
        F.col(f"target_datetime_{horizon}h").alias("target_datetime"),
        F.struct(
            F.coalesce(F.col(f"naive_forecast_{horizon}h"), F.lit(0.0)).alias("naive_forecast"),
            F.coalesce(F.col("congestion_threshold"), F.lit(0.0)).alias("congestion_threshold"),
            "classification",
            "reason",
        ).alias("_case"),
        *([tie_break] if tie_break in diagnosed.columns else []),
    )
    last = F.max_by("_case", tie_break) if tie_break in diagnosed.columns else F.max("_case")
    unique = case.groupBy("cell_id", "target_datetime").agg(last.alias("_case")).select(
        "cell_id", "target_datetime", "_case.*"
    )
    if covered is None:
        joined = unique.withColumns(
            {"deficit": F.lit(None).cast("double"), "covered": F.lit(None).cast("double"),
             "fully_resolved": F.lit(None).cast("boolean")}
        )
    else:
        found = covered.select(
            F.col(cell_col).alias("cell_id"), "target_datetime", "deficit", "covered", "fully_resolved"
        )
        joined = unique.join(found, ["cell_id", "target_datetime"], "left")
    indexed = range_index(joined, ["cell_id", "target_datetime"])
    return indexed.select((F.col("row_index") + 1).alias("id"), *joined.columns)


def build_sources(cases: DataFrame, moves: DataFrame, *, grid_size: int = GRID_SIZE) -> DataFrame:
    """Source table: moves with the id of their case; moves without a case are left out.

    Ids are dense from 1 in order of time, case cell and neighbour position.
    """
    ids = cases.select(F.col("id").alias("case_id"), F.col("cell_id").alias("congested_cell"), "target_datetime")
    matched = moves.join(ids, ["congested_cell", "target_datetime"]).withColumns(
        {
            "_dx": cell_x("source_cell", grid_size) - cell_x("congested_cell", grid_size),
            "_dy": cell_y("source_cell", grid_size) - cell_y("congested_cell", grid_size),
        }
    )
    indexed = range_index(matched, ["target_datetime", "congested_cell", "_dx", "_dy"])
    return indexed.select(
        (F.col("row_index") + 1).alias("id"), "case_id", F.col("source_cell").alias("source_cell_id"), "amount_moved"
    )


def empty_reports(spark) -> DataFrame:
    return spark.createDataFrame([], REPORTS_SCHEMA)


def build_serving_tables(
    diagnosed: DataFrame, covered: DataFrame | None, moves: DataFrame | None, *,
    horizon: int = 1, cell_col: str = "CellID", grid_size: int = GRID_SIZE,
) -> dict[str, DataFrame]:
    """The three tables of a full reload; reports start empty."""
    spark = diagnosed.sparkSession
    cases = materialise(build_cases(diagnosed, covered, horizon=horizon, cell_col=cell_col), "cases")
    if moves is None:
        sources = spark.createDataFrame([], "id long, case_id long, source_cell_id long, amount_moved double")
    else:
        sources = build_sources(cases, moves, grid_size=grid_size)
    return {"cases": cases, "sources": sources, "reports": empty_reports(spark)}


def with_report_presence(cases: DataFrame, reports: DataFrame) -> DataFrame:
    marks = reports.select(F.col("case_id").alias("id"), F.lit(True).alias("has_report")).dropDuplicates(["id"])
    return cases.join(marks, "id", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def list_cases(
    cases: DataFrame, reports: DataFrame, classification: str | None = None, limit: int = DEFAULT_CASE_LIMIT
) -> DataFrame:
    """The earliest cases, optionally of one class. The limit applies before reports are looked up."""
    chosen = cases.filter(F.col("classification") == classification.upper()) if classification else cases
    first = chosen.orderBy("target_datetime", "id").limit(limit)
    return with_report_presence(first, reports).select(
        "id", "cell_id", "target_datetime", "classification", "naive_forecast", "congestion_threshold",
        "deficit", "covered", "fully_resolved", "has_report",
    ).orderBy("target_datetime", "id")


def nested_sources(sources: DataFrame) -> DataFrame:
    """Per case the array of its sources in id order (at most eight per case)."""
    entry = F.struct("id", "source_cell_id", "amount_moved")
    plain = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda s: F.struct(s["source_cell_id"].alias("source_cell_id"), s["amount_moved"].alias("amount_moved")),
    )
    return sources.groupBy(F.col("case_id").alias("id")).agg(plain.alias("sources"))


def case_details(cases: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Every case with its sources (empty array if none) and its report (NULL if none)."""
    report = reports.select(F.col("case_id").alias("id"), F.struct("report_text", "generated_at").alias("report"))
    joined = cases.join(nested_sources(sources), "id", "left").join(report, "id", "left")
    none = F.array().cast("array<struct<source_cell_id:bigint,amount_moved:double>>")
    return joined.withColumn("sources", F.coalesce("sources", none))


def get_case(cases: DataFrame, sources: DataFrame, reports: DataFrame, case_id: int) -> DataFrame:
    """Detail of one case; the id is pushed into all three tables. An error when there is no such case."""
    found = cases.filter(F.col("id") == case_id)
    if found.isEmpty():
        raise LookupError(f"no case with id {case_id}")
    mine = F.col("case_id") == case_id
    return case_details(found, sources.filter(mine), reports.filter(mine))


def list_reports(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """All reports with the case they belong to."""
    case = cases.select(F.col("id").alias("case_id"), "cell_id", "target_datetime", "classification")
    return reports.join(case, "case_id").select(
        "case_id", "cell_id", "target_datetime", "classification", "generated_at"
    )


def generate_reports(cases: DataFrame, sources: DataFrame, case_ids: list[int] | None = None) -> DataFrame:
    """Report texts (case_id, report_text) for the given cases, or for all of them in bulk."""
    if case_ids is not None:
        cases = cases.filter(F.col("id").isin(case_ids))
        sources = sources.filter(F.col("case_id").isin(case_ids))
    nested = nested_sources(sources)
    joined = cases.join(nested, "id", "left")
    pairs = F.transform(
        F.coalesce("sources", F.array().cast("array<struct<source_cell_id:bigint,amount_moved:double>>")),
        lambda s: F.struct(s["source_cell_id"].alias("source"), s["amount_moved"].alias("amount")),
    )
    return joined.withColumn("sources", pairs).select(
        F.col("id").alias("case_id"), report_text(cell="cell_id").alias("report_text")
    )


def case_display(listed: DataFrame) -> DataFrame:
    """Listed cases as shown to an operator: rounded figures, Yes/No columns and a label."""

    def yes_no(c: str) -> Column:
        return F.when(F.col(c), "Yes").when(F.col(c).isNotNull(), "No")

    return listed.select(
        F.col("cell_id").alias("Cell"),
        time_text("target_datetime").alias("Target Time"),
        F.col("classification").alias("Classification"),
        round_binary("naive_forecast", 1).alias("Forecast"),
        round_binary("congestion_threshold", 1).alias("Threshold"),
        round_binary("deficit", 1).alias("Deficit"),
        round_binary("covered", 1).alias("Covered"),
        yes_no("fully_resolved").alias("Fully Resolved?"),
        yes_no("has_report").alias("Report?"),
        fill_template(
            CASE_LABEL, cell=F.col("cell_id"), time=time_text("target_datetime"), id=F.col("id")
        ).alias("label"),
    )
