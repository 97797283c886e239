"""Named queries over a folder of Parquet tables; every one reads whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import grid, scalars
from ..functions.fixed import ACTIVITY_COLUMNS, ROUTINE
from ..operators import (
    allocation,
    collapse,
    diagnosis as diag,
    dispatch,
    features,
    forecast,
    leafwise,
    neighbors,
    quantiles,
    reports,
    series,
    serving,
    thresholds,
    validation,
)
from ..operators.threshold_state import ThresholdState, rank_error, threshold_errors
from ..session import materialise, stage_path
from ..sources.tables import normalise_time
from . import event_panel as ep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = ["CellID", "datetime"]
WATCHED = {"north": 3, "centre": 13, "south": 23}
HORIZONS = (1, 2, 3, 4)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- load -----------------------------------------------------------------------------


@query
def country_code_collapse(spark, folder):
    return ep.collapsed(spark, folder).select(*KEY, "_source_file", *ACTIVITY_COLUMNS)


@query
def collapse_counts_per_file(spark, folder):
    return collapse.collapse_counts(ep.raw_activity(spark, folder))


@query
def daily_union(spark, folder):
    """Two layouts of the raw rows (weekdays, weekends in reverse column order), united by name and collapsed."""
    raw = ep.raw_activity(spark, folder)
    weekend = scalars.is_weekend("datetime")
    parts = [raw.filter(~weekend), raw.filter(weekend).select(*reversed(raw.columns))]
    return collapse.collapse_country_codes(reduce(DataFrame.unionByName, parts)).select(
        *KEY, "_source_file", *ACTIVITY_COLUMNS
    )


@query
def numeric_coercion(spark, folder):
    """Per event type: how many texts read as numbers, and their sum."""
    text = F.regexp_extract("props", r"\{(.*)\}", 1)
    pieces = _table(spark, folder, "events").select(
        "event_type", F.explode(F.split(text, ":")).alias("piece")
    )
    number = scalars.to_number("piece")
    return pieces.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count(number).alias("n_numbers"),
        F.coalesce(F.sum(number), F.lit(0.0)).alias("total"),
    )


@query
def normalised_times(spark, folder):
    """The same instants from epoch milliseconds and from text."""
    ts = F.col("ts").cast("timestamp")
    both = _table(spark, folder, "events").select(
        "event_id", F.unix_millis(ts).alias("from_ms"), F.col("ts").cast("string").alias("from_text")
    )
    return normalise_time(normalise_time(both, "from_ms"), "from_text")


@query
def missing_value_profile(spark, folder):
    return collapse.missing_profile(ep.raw_activity(spark, folder))


@query
def load_overview(spark, folder):
    return collapse.overview(ep.collapsed(spark, folder))


@query
def sampling_step(spark, folder):
    return collapse.sampling_step(ep.collapsed(spark, folder))


@query
def first_rows(spark, folder):
    return collapse.sample_rows(ep.collapsed(spark, folder), [*KEY, "_source_file"]).select(
        *KEY, "_source_file", *ACTIVITY_COLUMNS
    )


# ---- scalar expressions and the grid ----------------------------------------------------


@query
def total_activity(spark, folder):
    return ep.panel(spark, folder).select(*KEY, "total_activity")


@query
def calendar_parts(spark, folder):
    return features.with_calendar_parts(ep.collapsed(spark, folder)).select(
        *KEY, "hour_of_day", "day_of_week", "is_weekend"
    )


def _part_cells(spark, folder):
    """Part keys laid out row by row on the 100 x 100 grid, again and again."""
    key = F.col("p_partkey")
    return _table(spark, folder, "part").select("p_partkey", (F.pmod(key, F.lit(10_000)) + 1).alias("cell"))


@query
def grid_positions(spark, folder):
    """Position, neighbour count and the way back."""
    placed = _part_cells(spark, folder).withColumns({"x": grid.cell_x("cell"), "y": grid.cell_y("cell")})
    return placed.select(
        "p_partkey", "x", "y", grid.cell_at("x", "y").alias("again"), grid.neighbor_total("cell").alias("n_neighbors")
    )


@query
def grid_neighbors(spark, folder):
    return neighbors.neighbor_rows(_part_cells(spark, folder), cell_col="cell")


@query
def target_times(spark, folder):
    target = scalars.shift_hours("datetime", 3)
    return ep.collapsed(spark, folder).select(
        *KEY, target.alias("target"), scalars.hour_key(target).alias("target_hour"),
        scalars.source_date(target).cast("string").alias("source_date"),
    )


@query
def hour_band_activity(spark, folder):
    """Evening and daytime rows per cell, bounds included."""
    hour = scalars.hour_of("datetime")
    band = F.when(hour.between(18, 23), "evening").when(hour.between(6, 17), "daytime")
    rows = ep.collapsed(spark, folder).withColumn("band", band).filter("band is not null")
    return rows.groupBy("CellID", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("internet").alias("internet")
    )


@query
def log_scale_round_trip(spark, folder):
    logged = scalars.log_scale("total_activity")
    return ep.panel(spark, folder).select(
        *KEY, _rounded(logged, 9).alias("logged"), _rounded(scalars.from_log_scale(logged), 3).alias("back"),
        _rounded(scalars.from_log_scale(logged - 8), 3).alias("shifted_back"),
        scalars.at_least("internet").alias("clipped"),
    )


@query
def supply_shortfall(spark, folder):
    """Per order: shortfall of each line's quantity against 25 units, as rows and as arrays."""
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", dispatch.shortfall("l_quantity", F.lit(25.0)).alias("short"),
        dispatch.array_shortfall(F.array("l_quantity", "l_tax"), F.array(F.lit(25.0), F.lit(0.04))).alias("pair"),
    )
    return lines.groupBy("l_orderkey").agg(
        F.sum("short").alias("shortfall"), F.sum(F.col("pair")[0]).alias("pair_shortfall"),
        F.count_if(F.col("pair")[1] > 0).alias("n_tax_short"),
    )


@query
def residual_status(spark, folder):
    """Seasonal forecast against actual value, within a tenth of the cell's threshold."""
    risk = ep.risk_panel(spark, folder).filter("naive_forecast_1h is not null")
    status = dispatch.residual_status("naive_forecast_1h", "total_activity", F.col("congestion_threshold") / 10)
    return risk.groupBy("CellID", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- thresholds -------------------------------------------------------------------------


@query
def percentile_thresholds(spark, folder):
    return thresholds.percentile_thresholds(ep.staged_panel(spark, folder))


@query
def percentile_thresholds_as_of(spark, folder):
    return thresholds.percentile_thresholds(ep.staged_panel(spark, folder), percentile=75, as_of="2024-01-15 00:00:00")


def _threshold_state(spark, folder) -> tuple[DataFrame, ThresholdState]:
    """The state of the panel, added in two parts of which the second holds three days once more."""
    rows = ep.staged_panel(spark, folder)
    state = ThresholdState(spark, stage_path(spark, "threshold-state"))
    state.add(rows.filter(F.to_date("datetime") <= F.lit(dt.date(2024, 1, 20))))
    state.add(rows.filter(F.to_date("datetime") >= F.lit(dt.date(2024, 1, 18))))
    return rows, state


WINDOW = dt.date(2024, 1, 8), dt.date(2024, 1, 28)


@query
def merged_threshold_errors(spark, folder):
    """Of thresholds merged from stored days: the counted rank error, held against the bound."""
    rows, state = _threshold_state(spark, folder)
    inside = rows.filter(F.to_date("datetime").between(*[F.lit(d) for d in WINDOW]))
    errors = threshold_errors(inside, materialise(state.thresholds(*WINDOW), "merged"))
    return errors.select("CellID", "n", (F.col("rank_error") <= rank_error(state.size) + 1 / F.col("n")).alias("within_bound"))


@query
def window_thresholds(spark, folder):
    """Exact thresholds of a window of days: ranks counted inside the bracket of the merged sketches."""
    rows, state = _threshold_state(spark, folder)
    return state.exact_thresholds(rows, *WINDOW).withColumn("congestion_threshold", _rounded("congestion_threshold"))


@query
def congestion_flags(spark, folder):
    return ep.flagged_panel(spark, folder).select(
        *KEY, "total_activity", "congestion_threshold", "is_congestion_risk"
    )


@query
def order_price_quantiles(spark, folder):
    """The same quantile operator on the line prices of the sales tables, per return flag and line status."""
    lines = _table(spark, folder, "lineitem")
    return quantiles.group_quantile(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9)


@query
def mean_to_max_flags(spark, folder):
    return thresholds.flag_mean_to_max(ep.staged_panel(spark, folder)).select(
        *KEY, "total_activity", _rounded("loubar_threshold").alias("loubar_threshold"),
        _rounded("loubar_f_star", 9).alias("loubar_f_star"), "is_congestion_risk",
    )


@query
def spatial_hotspots(spark, folder):
    """The mean-to-max rule across cells at one time."""
    return thresholds.flag_mean_to_max(ep.staged_panel(spark, folder), keys=["datetime"]).select(
        *KEY, "total_activity", _rounded("loubar_threshold").alias("loubar_threshold"),
        _rounded("loubar_f_star", 9).alias("loubar_f_star"), "is_congestion_risk",
    )


@query
def f_star_distribution(spark, folder):
    flagged = thresholds.flag_mean_to_max(ep.staged_panel(spark, folder))
    per_cell = thresholds.one_row_per_cell(flagged, ["loubar_f_star"])
    described = thresholds.describe_groups(per_cell)
    return described.select("count", *[_rounded(c, 9).alias(c) for c in described.columns if c != "count"])


@query
def one_row_per_cell(spark, folder):
    return thresholds.one_row_per_cell(ep.flagged_panel(spark, folder), ["congestion_threshold"])


@query
def flag_rate(spark, folder):
    found = thresholds.flag_rate(ep.flagged_panel(spark, folder))
    return found.withColumn("flagged_pct", _rounded("flagged_pct"))


@query
def watched_flag_rates(spark, folder):
    found = thresholds.watched_flag_rates(ep.flagged_panel(spark, folder), WATCHED)
    return found.withColumn("flagged_pct", _rounded("flagged_pct"))


# ---- validation -------------------------------------------------------------------------


@query
def known_pattern_report(spark, folder):
    report = validation.known_pattern_report(ep.staged_panel(spark, folder), university=3, nightlife=13, centre=23)
    return report.withColumns({"a": _rounded("a"), "b": _rounded("b")})


@query
def cell_percentile_ranks(spark, folder):
    ranks = validation.cell_percentile_ranks(ep.staged_panel(spark, folder), WATCHED)
    return ranks.withColumns({"mean_value": _rounded("mean_value"), "percentile": _rounded("percentile")})


# ---- series and neighbours --------------------------------------------------------------

LAG_SHIFTS = {
    "lag_1h": ("total_activity", 1), "lag_24h": ("total_activity", 24),
    "target_1h": ("total_activity", -1), "target_4h": ("total_activity", -4), "baseline_1h": ("total_activity", 23),
}


@query
def cell_lags(spark, folder):
    return series.shift_rows(ep.panel(spark, folder), LAG_SHIFTS, order=ep.UNIQUE_ORDER).select(*KEY, *LAG_SHIFTS)


@query
def long_series_lags(spark, folder):
    """The same lags in blocks, for series too long for one task."""
    shifted = series.shift_rows_blocked(
        ep.staged_panel(spark, folder), LAG_SHIFTS, order=ep.UNIQUE_ORDER, block_rows=64
    )
    return shifted.select(*KEY, *LAG_SHIFTS)


@query
def clock_hour_lags(spark, folder):
    """Shifts by clock hours instead of rows."""
    return series.shift_hours_aligned(ep.panel(spark, folder), LAG_SHIFTS).select(*KEY, *LAG_SHIFTS)


@query
def whole_frame_lags(spark, folder):
    """Generic lag and calendar features over the whole frame, in (time, cell) order."""
    order = ["datetime", "CellID", "_source_file"]
    built = features.add_lag_and_seasonal_features(
        ep.staged_panel(spark, folder), "total_activity", time_col="datetime", order=order
    )
    return built.select(
        *KEY, "hour", "day_of_week", "is_weekend", *[f"total_activity_lag_{k}" for k in (1, 24, 168)]
    )


@query
def supplier_line_lags(spark, folder):
    """Generic lags within a partition, on the sales tables: earlier prices of the same supplier."""
    lines = _table(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    built = features.add_lag_and_seasonal_features(
        lines, "l_extendedprice", time_col="l_shipdate", lags=(1, 7), partition=["l_suppkey"],
        order=["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"],
    )
    return built.drop("hour")


@query
def one_value_per_cell_time(spark, folder):
    """The long form of the time x cell matrix."""
    return neighbors.one_value_per_cell_time(ep.panel(spark, folder))


@query
def neighbor_average(spark, folder):
    averaged = neighbors.with_neighbor_average(ep.staged_panel(spark, folder), grid_size=ep.GRID)
    return averaged.select(*KEY, _rounded("neighbor_avg_activity").alias("neighbor_avg_activity"))


def _matrix(spark, folder, **options):
    return features.forecast_features(
        ep.staged_panel(spark, folder), order=ep.UNIQUE_ORDER, grid_size=ep.GRID, **options
    )


FEATURE_COLUMNS = [
    "lag_1h", "lag_2h", "lag_3h", "lag_24h", "hour_of_day", "day_of_week", "is_weekend",
    *[f"{p}_{h}h" for p in ("target", "baseline") for h in HORIZONS],
]


@query
def forecast_features(spark, folder):
    rows = features.complete_rows(_matrix(spark, folder))
    return rows.select(*KEY, *FEATURE_COLUMNS, _rounded("neighbor_avg_lag1h").alias("neighbor_avg_lag1h"))


@query
def dropped_feature_rows(spark, folder):
    dropped = features.dropped_share(_matrix(spark, folder))
    return dropped.withColumn("dropped_share", _rounded("dropped_share", 9))


# ---- forecasting ------------------------------------------------------------------------


def _split(spark, folder):
    matrix = materialise(features.complete_rows(_matrix(spark, folder)), "matrix")
    return forecast.chronological_split(matrix)


@query
def chronological_split(spark, folder):
    train, test = _split(spark, folder)
    parts = [p.select(F.lit(n).alias("part"), *KEY, "cell_historical_mean") for n, p in (("train", train), ("test", test))]
    return reduce(DataFrame.unionByName, parts).groupBy("part", "CellID").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"),
        _rounded(F.max("cell_historical_mean")).alias("cell_mean"),
    )


@query
def baseline_error_metrics(spark, folder):
    _, test = _split(spark, folder)
    found = forecast.evaluate(test, with_model=False)
    return found.withColumns({c: _rounded(c) for c in ("mae_base", "mape_base")})


@query
def boosted_tree_metrics(spark, folder):
    """Trains one model per horizon; figures depend on the trees, so only the rows are comparable."""
    train, test = (materialise(p, n) for n, p in zip(("train", "test"), _split(spark, folder)))
    models = forecast.fit_horizons(train, grid_size=ep.GRID)
    return forecast.evaluate(forecast.predict_horizons(test, models, grid_size=ep.GRID))


@query
def boosted_tree_importances(spark, folder):
    train, _ = _split(spark, folder)
    models = forecast.fit_horizons(materialise(train, "train"), (1,), grid_size=ep.GRID)
    return forecast.top_importances(models, spark)


@query
def boosted_tree_checks(spark, folder):
    """Rows and baseline errors of every horizon and stratum, and whether the model's errors are numbers of at least 0."""
    train, test = (materialise(p, n) for n, p in zip(("train", "test"), _split(spark, folder)))
    models = forecast.fit_horizons(train, grid_size=ep.GRID, trees=5)
    found = forecast.evaluate(forecast.predict_horizons(test, models, grid_size=ep.GRID))
    usable = F.coalesce((F.col("mae_model") >= 0) & (F.col("mae_model") < float("inf")), F.lit(False))
    return found.select("horizon", "stratum", "n", *[_rounded(c).alias(c) for c in ("mae_base", "mape_base")], usable.alias("model_ok"))


@query
def copied_target_importance(spark, folder):
    """The most important input of each horizon when every target is a copy of one input."""
    train, _ = _split(spark, folder)
    copied = materialise(train.withColumns({f"target_{h}h": F.col("lag_24h") for h in HORIZONS}), "train")
    models = forecast.fit_horizons(copied, grid_size=ep.GRID, trees=3)
    return forecast.top_importances(models, spark, 1).select("horizon", "feature")


@query
def leafwise_metrics(spark, folder):
    """Errors of leaf-wise trees with the cell as a category, all horizons; figures depend on the trees, so only the rows are comparable."""
    train, test = (materialise(p, n) for n, p in zip(("train", "test"), _split(spark, folder)))
    models = leafwise.fit_leafwise(train)
    return forecast.evaluate(leafwise.predict_leafwise(test, models))


@query
def leafwise_first_split(spark, folder):
    """The first split of each horizon's first tree over the calendar and the cell: what it tests, its gain, and both sides."""
    train, _ = _split(spark, folder)
    models = leafwise.fit_leafwise(materialise(train, "train"), inputs=features.CALENDAR_FEATURES, trees=1, leaves=2)
    rows = []
    for h, model in models.items():
        for splits, values in model.trees:
            s = splits[0]
            cells = None if s.left is None else ",".join(str(c) for c, low in zip(model.categories, s.left) if low)
            bar = None if s.left is not None else float(model.edges[s.feature][s.bin])
            name = [*model.inputs, model.category][s.feature]
            rows.append((h, name, bar, cells, round(s.gain, 6), round(values[s.low], 9), round(values[s.high], 9)))
    return spark.createDataFrame(
        rows, "horizon int, feature string, bar double, low_cells string, gain double, low_value double, high_value double"
    )


@query
def external_model_scores(spark, folder):
    """Scores of a model from outside: the mean of the last and the day-old value."""

    class BlendModel:
        def predict(self, frame):
            return (frame["lag_1h"] + frame["lag_24h"]) / 2

    rows = features.complete_rows(_matrix(spark, folder)).select(*KEY, "lag_1h", "lag_24h")
    return forecast.score_with(rows, BlendModel(), ["lag_1h", "lag_24h"])


# ---- risk and diagnosis -----------------------------------------------------------------


@query
def predicted_risk(spark, folder):
    risk = ep.risk_panel(spark, folder)
    return risk.select(
        *KEY, *[f"{c}_{h}h" for h in HORIZONS for c in ("naive_forecast", "predicted_risk", "target_datetime")]
    )


@query
def predicted_risk_by_horizon(spark, folder):
    long = diag.risk_long(ep.risk_panel(spark, folder))
    return long.select(*KEY, "horizon", "forecast", "predicted_risk", "target_datetime")


@query
def at_risk_cells_per_hour(spark, folder):
    risky = ep.risk_panel(spark, folder).filter("predicted_risk_1h")
    return risky.select(scalars.hour_key("target_datetime_1h").alias("target_hour_key"), "CellID").distinct()


@query
def neighbor_risk_counts(spark, folder):
    risky = ep.risk_panel(spark, folder).filter("predicted_risk_1h").withColumn(
        "target_hour_key", scalars.hour_key("target_datetime_1h")
    )
    counted = neighbors.with_neighbor_hits(risky, grid_size=ep.GRID)
    return counted.select(
        "CellID", "target_hour_key", "neighbors_at_risk", grid.neighbor_total("CellID", ep.GRID).alias("n_neighbors")
    )


@query
def diagnosis(spark, folder):
    found = ep.diagnosis(ep.risk_panel(spark, folder))
    return found.select(
        *KEY, "naive_forecast_1h", "congestion_threshold", "target_datetime_1h", "target_hour_key",
        "classification", "reason",
    )


@query
def diagnosis_all_horizons(spark, folder):
    return diag.diagnose_all(ep.risk_panel(spark, folder), holidays=ep.HOLIDAYS, grid_size=ep.GRID)


@query
def calendar_table_diagnosis(spark, folder):
    """Holidays from a calendar table: here the days with 2 % more events than the average day."""
    days = _table(spark, folder, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    average = days.agg(F.avg("n")).scalar()
    holidays = days.filter(F.col("n") > average * 1.02).select("date")
    found = diag.diagnose(ep.risk_panel(spark, folder), 2, holidays=holidays, grid_size=ep.GRID)
    return found.select("CellID", "target_datetime_2h", "classification", "reason")


@query
def class_shares(spark, folder):
    risk = ep.staged_risk_panel(spark, folder)
    shares = diag.class_shares(materialise(ep.diagnosis(risk), "diagnosis"), risk)
    return shares.withColumns({c: _rounded(c, 9) for c in ("share", "flagged_share")})


@query
def routine_cases(spark, folder):
    found = allocation.routine_cases(ep.diagnosis(ep.risk_panel(spark, folder)))
    return found.withColumn("deficit", _rounded("deficit"))


# ---- allocation -------------------------------------------------------------------------


def _edges(spark, folder):
    """Routine cases, their candidate edges, and the diagnosis, from one staged risk panel."""
    risk = ep.staged_risk_panel(spark, folder)
    diagnosed = materialise(ep.diagnosis(risk), "diagnosis")
    cases = allocation.routine_cases(diagnosed)
    edges = allocation.candidate_edges(cases, allocation.capacity(risk), grid_size=ep.GRID)
    return diagnosed, cases, edges


@query
def capacities(spark, folder):
    found = allocation.capacity(ep.risk_panel(spark, folder))
    return found.select(
        "CellID", "target_datetime", "forecast", _rounded("deficit").alias("deficit"), _rounded("spare").alias("spare")
    )


@query
def candidate_edges(spark, folder):
    _, _, edges = _edges(spark, folder)
    return edges.withColumns({"deficit": _rounded("deficit"), "spare": _rounded("spare")})


@query
def reallocation_plan(spark, folder):
    """The best plan itself; its total is unique, its single amounts are not."""
    _, _, edges = _edges(spark, folder)
    return allocation.allocate(edges)


@query
def reallocation_per_hour(spark, folder):
    """Moved total of every hour of the best plan, and the moves that are not positive or above what either end allows."""
    _, _, edges = _edges(spark, folder)
    edges = materialise(edges, "edges")
    moves = allocation.allocate(edges).join(edges, ["target_datetime", "congested_cell", "source_cell"], "left")
    within = (F.col("amount_moved") > 0) & (F.col("amount_moved") <= F.least("deficit", "spare") + 1e-6)
    return moves.groupBy("target_datetime").agg(
        _rounded(F.sum("amount_moved"), 3).alias("moved"), F.count_if(~F.coalesce(within, F.lit(False))).alias("n_out_of_bounds")
    )


@query
def coverage_per_hour(spark, folder):
    """Needed and covered amount of every hour with routine cases. The covered total of the best plan is unique."""
    _, cases, edges = _edges(spark, folder)
    covered = allocation.coverage(cases, allocation.allocate(edges))
    return covered.groupBy("target_datetime").agg(
        F.count(F.lit(1)).alias("n_cases"), _rounded(F.sum("deficit"), 3).alias("deficit"),
        _rounded(F.sum("covered"), 3).alias("covered"),
    )


@query
def coverage_per_hour_in_rounds(spark, folder):
    """The same totals from the method for very large grids."""
    _, cases, edges = _edges(spark, folder)
    covered = allocation.coverage(cases, allocation.allocate(edges))
    return covered.groupBy("target_datetime").agg(
        F.count(F.lit(1)).alias("n_cases"), _rounded(F.sum("deficit"), 3).alias("deficit"),
        _rounded(F.sum("covered"), 3).alias("covered"),
    )


@query
def coverage_totals(spark, folder):
    _, cases, edges = _edges(spark, folder)
    covered = allocation.coverage(cases, allocation.allocate(edges))
    totals = allocation.coverage_totals(covered)
    return totals.select(
        "n_cases", "n_hours", _rounded("total_deficit", 3).alias("total_deficit"),
        _rounded("total_covered", 3).alias("total_covered"), _rounded("coverage_rate").alias("coverage_rate"),
    )


@query
def plan_violations(spark, folder):
    """Per hour with candidate edges: overdrawn cases and sources, and the gap to the proving cut (all zero)."""
    _, _, edges = _edges(spark, folder)
    edges = materialise(edges, "edges")
    plan = materialise(allocation.solve(edges), "plan")
    checked = allocation.plan_check(edges, plan)
    return checked.select(
        "target_datetime", "cases_overdrawn", "sources_overdrawn",
        _rounded(F.abs(F.col("moved") - F.col("cut_capacity")), 3).alias("gap"),
    )


@query
def coverage_of_even_plan(spark, folder):
    _, cases, edges = _edges(spark, folder)
    found = allocation.coverage(cases, ep.even_moves(edges))
    return found.withColumns({c: _rounded(c, 3) for c in ("deficit", "covered")})


@query
def hours_with_routine_cases(spark, folder):
    _, cases, _ = _edges(spark, folder)
    return cases.select("target_datetime").distinct().orderBy("target_datetime")


# ---- reports and serving ----------------------------------------------------------------


def _moves(spark, folder):
    diagnosed, cases, edges = _edges(spark, folder)
    return diagnosed, cases, materialise(ep.even_moves(edges), "moves")


def _case_table(spark, folder):
    """Case table with the even plan, and the plan."""
    diagnosed, cases, moves = _moves(spark, folder)
    return serving.build_cases(diagnosed, allocation.coverage(cases, moves)), moves


def _serving(spark, folder):
    """Serving tables with the even plan; reports start empty."""
    cases, moves = _case_table(spark, folder)
    cases = materialise(cases, "cases")
    sources = materialise(serving.build_sources(cases, moves, grid_size=ep.GRID), "sources")
    return {"cases": cases, "sources": sources, "reports": serving.empty_reports(spark)}


def _reported(tables):
    """Report table with one report per routine case."""
    routine = tables["cases"].filter(F.col("classification") == ROUTINE)
    texts = serving.generate_reports(routine, tables["sources"])
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return reports.upsert_reports(tables["reports"], texts, now=now)


@query
def assembled_cases(spark, folder):
    """Diagnosed rows with coverage and their nested sources, as text."""
    diagnosed, cases, moves = _moves(spark, folder)
    built = reports.assemble_cases(diagnosed, allocation.coverage(cases, moves), moves, grid_size=ep.GRID)
    listed = F.array_join(
        F.transform("sources", lambda s: F.concat(s["source"].cast("string"), F.lit(":"), scalars.fixed_decimals(s["amount"], 1))),
        "|",
    )
    return built.select(
        "CellID", "target_datetime", "classification", _rounded("deficit", 3).alias("deficit"),
        _rounded("covered", 3).alias("covered"), "fully_resolved", listed.alias("sources"),
    )


@query
def case_reports(spark, folder):
    """Report text of every diagnosed case."""
    diagnosed, cases, moves = _moves(spark, folder)
    built = reports.assemble_cases(diagnosed, allocation.coverage(cases, moves), moves, grid_size=ep.GRID)
    return reports.with_reports(built).select("CellID", "target_datetime", "classification", "report")


@query
def first_cases_per_class(spark, folder):
    found = ep.diagnosis(ep.risk_panel(spark, folder)).withColumnRenamed("target_datetime_1h", "target_datetime")
    return reports.first_per_class(found).select("CellID", "target_datetime", "classification", "reason")


@query
def case_table(spark, folder):
    cases, _ = _case_table(spark, folder)
    return cases.withColumns({c: _rounded(c, 3) for c in ("deficit", "covered")})


@query
def source_table(spark, folder):
    cases, moves = _case_table(spark, folder)
    sources = serving.build_sources(cases, moves, grid_size=ep.GRID)
    return sources.withColumn("amount_moved", _rounded("amount_moved", 3))


@query
def report_upsert(spark, folder):
    """Reports of routine cases, then a second round over all cases that keeps ids and times of the first."""
    tables = _serving(spark, folder)
    first = materialise(_reported(tables), "reports")
    texts = serving.generate_reports(tables["cases"], tables["sources"])
    return reports.upsert_reports(first, texts, now=F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))


def _with_reports(spark, folder):
    tables = _serving(spark, folder)
    tables["reports"] = materialise(_reported(tables), "reports")
    return tables


@query
def listed_cases(spark, folder):
    t = _with_reports(spark, folder)
    found = serving.list_cases(t["cases"], t["reports"], limit=50)
    return found.withColumns({c: _rounded(c, 3) for c in ("deficit", "covered")})


@query
def listed_routine_cases(spark, folder):
    t = _with_reports(spark, folder)
    found = serving.list_cases(t["cases"], t["reports"], "routine")
    return found.withColumns({c: _rounded(c, 3) for c in ("deficit", "covered")})


@query
def displayed_cases(spark, folder):
    t = _with_reports(spark, folder)
    return serving.case_display(serving.list_cases(t["cases"], t["reports"], limit=100))


@query
def case_details(spark, folder):
    t = _with_reports(spark, folder)
    found = serving.case_details(t["cases"], t["sources"], t["reports"])
    listed = F.array_join(F.transform("sources", lambda s: s["source_cell_id"].cast("string")), ",")
    return found.select(
        "id", "cell_id", "target_datetime", "reason", listed.alias("source_cells"),
        F.col("report.report_text").alias("report_text"), F.col("report.generated_at").alias("generated_at"),
    )


@query
def single_case(spark, folder):
    t = _with_reports(spark, folder)
    found = serving.get_case(t["cases"], t["sources"], t["reports"], 1)
    return found.select(
        "id", "cell_id", "target_datetime", "classification", "reason", F.size("sources").alias("n_sources"),
        F.col("report").isNotNull().alias("has_report"),
    )


@query
def listed_reports(spark, folder):
    t = _with_reports(spark, folder)
    return serving.list_reports(t["cases"], t["reports"])
