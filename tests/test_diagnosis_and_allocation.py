import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import allocation, diagnosis
from cellgrid.plans import event_panel as ep
from cellgrid.session import materialise

from .conftest import TESTDATA

T0 = dt.datetime(2024, 3, 10, 12)
RISK_SCHEMA = (
    "CellID long, target_datetime_1h timestamp_ntz, naive_forecast_1h double, "
    "congestion_threshold double, predicted_risk_1h boolean"
)


def risk(spark, rows):
    """(cell, target, forecast, threshold) rows."""
    return spark.createDataFrame([(*r, r[2] is not None and r[2] > r[3]) for r in rows], RISK_SCHEMA)


def reasons(df):
    return {(r.CellID, r.target_datetime_1h): (r.classification, r.reason) for r in df.collect()}


def test_block_is_routine_and_single_spike_is_not(spark):
    block = [5050 + dx + 100 * dy for dx in (0, 1, 2) for dy in (0, 1, 2)]
    rows = [(c, T0, 9.0, 1.0) for c in [*block, 1, 50]]
    got = reasons(diagnosis.diagnose(risk(spark, rows), holidays=()))
    assert got[(5050, T0)] == ("ROUTINE", "3/8 neighbors also at risk")
    assert got[(5151, T0)] == ("ROUTINE", "8/8 neighbors also at risk")
    assert got[(1, T0)] == ("ANOMALOUS", "isolated — only 0/3 neighbors at risk")
    assert got[(50, T0)] == ("ANOMALOUS", "isolated — only 0/5 neighbors at risk")


def test_order_of_the_four_reasons(spark):
    day = dt.timedelta(days=1)
    rows = [(1, T0, 9.0, 1.0), (1, T0 + day, 9.0, 1.0), (5050, T0 + day, 9.0, 1.0), (5051, T0 + day, 9.0, 1.0),
            (5150, T0 + day, 9.0, 1.0), (5151, T0 + day, 9.0, 1.0), (1, T0 + 5 * day, 9.0, 1.0)]
    for holidays in (["2024-03-10"], spark.createDataFrame([(dt.date(2024, 3, 10),), (None,)], "date date")):
        got = reasons(diagnosis.diagnose(risk(spark, rows), holidays=holidays))
        assert got[(1, T0)] == ("ROUTINE", "target date is a known holiday")
        assert got[(1, T0 + day)] == (
            "ANOMALOUS", "isolated, AND forecast is based on a holiday — basis may be unreliable")
        assert got[(5050, T0 + day)] == ("ROUTINE", "3/8 neighbors also at risk")  # comes before the source day
        assert got[(1, T0 + 5 * day)] == ("ANOMALOUS", "isolated — only 0/3 neighbors at risk")


def test_neighbors_count_by_hour_and_without_rows_the_schema_stays(spark):
    rows = [(1, T0 + dt.timedelta(minutes=10), 9.0, 1.0), (2, T0 + dt.timedelta(minutes=50), 9.0, 1.0), (3, T0, 0.0, 1.0),
            (4, T0, None, 1.0)]
    got = diagnosis.diagnose(risk(spark, rows), holidays=())
    assert [r.reason for r in got.filter("CellID = 1").collect()] == ["1/3 neighbors also at risk"]
    empty = diagnosis.diagnose(risk(spark, rows).filter("CellID > 2"), holidays=())
    assert empty.columns == got.columns and empty.isEmpty()


def test_horizons_do_not_mix(spark):
    base = [(c, T0 + dt.timedelta(hours=h), float(v)) for c, v in ((1, 9), (2, 9)) for h in range(30)]
    df = spark.createDataFrame(base, "CellID long, datetime timestamp_ntz, total_activity double").withColumn(
        "congestion_threshold", F.when(F.col("CellID") == 1, 1.0).otherwise(10.0)
    )
    panel = diagnosis.predicted_risk(df)
    assert panel.filter("naive_forecast_1h IS NOT NULL").count() == 2 * 7
    every = diagnosis.diagnose_all(panel, holidays=())
    for h in (1, 2, 3, 4):
        single = diagnosis.diagnose(panel, h, holidays=()).select(
            "CellID", F.col(f"target_datetime_{h}h").alias("target_datetime"), "classification", "reason")
        assert every.filter(F.col("horizon") == h).select(*single.columns).exceptAll(single).isEmpty()
        assert single.count() == 30 - 24 + h


@pytest.mark.parametrize("sf,expected", [
    ("0.001", (951, 61, 0, 0, 0, 61)), ("0.01", (7653, 712, 28, 19, 22, 643)), ("0.1", (17925, 1741, 58, 171, 103, 1409)),
])
def test_known_figures_of_the_event_panel(spark, sf, expected):
    panel = ep.staged_risk_panel(spark, f"{TESTDATA}/sf{sf}")
    found = ep.diagnosis(panel)
    kinds = found.agg(
        F.count("*"), F.count_if(F.expr("reason = 'target date is a known holiday'")), F.count_if(F.expr("reason LIKE '%also at risk'")),
        F.count_if(F.expr("reason LIKE '%holiday — basis%'")), F.count_if(F.expr("reason LIKE 'isolated — only%'")),
    ).first()
    assert (panel.count(), *kinds) == expected


# ---- allocation -------------------------------------------------------------------------


EDGES = "target_datetime timestamp_ntz, congested_cell long, deficit double, pos int, source_cell long, spare double"


def best_total(deficits, spares, pairs):
    """Least cut over all sets of cases."""
    cases = sorted({c for c, _ in pairs})
    totals = []
    for k in range(len(cases) + 1):
        for inside in itertools.combinations(cases, k):
            touched = {s for c, s in pairs if c in inside}
            totals.append(sum(deficits[c] for c in cases if c not in inside) + sum(spares[s] for s in touched))
    return min(totals)


def test_plans_are_optimal_and_feasible(spark):
    """Many small random hours in one edge table, each against the least cut over all sets of cases."""
    rng, rows, want, bounds = random.Random(4), [], {}, {}
    for h in range(150):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        amount = lambda: float(rng.randint(1, 20)) if rng.random() < 0.5 else rng.uniform(0.01, 50)
        deficits, spares = {c: amount() for c in range(n)}, {100 + s: amount() for s in range(m)}
        pairs = [(c, s) for c in deficits for s in spares if rng.random() < 0.5] or [(0, 100)]
        hour = T0 + dt.timedelta(hours=h)
        rows += [(hour, c, deficits[c], i, s, spares[s]) for i, (c, s) in enumerate(pairs)]
        want[hour], bounds[hour] = best_total(deficits, spares, pairs), set(pairs)
    edges = materialise(spark.createDataFrame(rows, EDGES))
    plan = materialise(allocation.solve(edges))
    for r in allocation.plan_check(edges, plan).collect():
        assert abs(r.moved - want[r.target_datetime]) < 1e-5 and abs(r.cut_capacity - r.moved) < 1e-5
        assert r.cases_overdrawn == r.sources_overdrawn == 0
    assert all((r.congested_cell, r.source_cell) in bounds[r.target_datetime] for r in plan.filter("kind = 'move'").collect())


@pytest.mark.parametrize("g, share", [(9, 0.15), (9, 0.8), (60, 0.5)])
def test_cut_proves_the_plan(spark, g, share):
    rng = random.Random(int(share * 100))
    rows = []
    for h in range(2 if g > 9 else 6):
        for c in range(1, g * g + 1):
            case = rng.random() < share
            rows.append((c, T0 + dt.timedelta(hours=h), rng.randint(1, 90) / 4 if case else 0.0, 0.0 if case else rng.randint(0, 90) / 4))
    cells = spark.createDataFrame(rows, "CellID long, target_datetime timestamp_ntz, deficit double, spare double")
    cases = cells.filter("deficit > 0").select("CellID", "target_datetime", "deficit")
    edges = materialise(allocation.candidate_edges(cases, cells, grid_size=g))
    for r in allocation.plan_check(edges, materialise(allocation.solve(edges))).collect():
        assert abs(r.moved - r.cut_capacity) < 1e-6 and r.moved > 0 and r.cases_overdrawn == r.sources_overdrawn == 0


def test_shared_source_is_not_promised_twice(spark):
    cells = spark.createDataFrame(
        [(1, T0, 5.0, 0.0), (3, T0, 5.0, 0.0), (2, T0, 0.0, 6.0), (10, T0, 4.0, 0.0)],
        "CellID long, target_datetime timestamp_ntz, deficit double, spare double")
    cases = cells.filter("deficit > 0").select("CellID", "target_datetime", "deficit")
    edges = allocation.candidate_edges(cases, cells, grid_size=4)
    covered = allocation.coverage(cases, allocation.allocate(edges))
    rows = {r.CellID: r for r in covered.collect()}
    assert rows[1].covered + rows[3].covered == 6.0
    assert (rows[10].covered, rows[10].fully_resolved) == (0.0, False)  # no neighbour with a row
    totals = allocation.coverage_totals(covered).first()
    assert (totals.n_cases, totals.total_deficit, totals.total_covered) == (3, 14.0, 6.0)


def test_empty_plan(spark):
    none = spark.createDataFrame([], EDGES)
    assert allocation.allocate(none).isEmpty()
    assert allocation.coverage_totals(allocation.coverage(
        spark.createDataFrame([], "CellID long, target_datetime timestamp_ntz, deficit double"), allocation.allocate(none))).first().coverage_rate is None


def test_duplicate_cell_time_last_file_counts(spark):
    df = risk(spark, [(1, T0, 5.0, 3.0), (1, T0, 9.0, 3.0), (2, T0, None, 3.0)]).withColumn(
        "_source_file", F.when(F.col("naive_forecast_1h") == 5, "a").otherwise("b"))
    got = allocation.capacity(df).collect()
    assert [(r.CellID, r.forecast, r.deficit, r.spare) for r in got] == [(1, 9.0, 6.0, 0.0)]
    cases = allocation.routine_cases(diagnosis.diagnose(df, holidays=["2024-03-10"])).collect()
    assert [(r.CellID, r.deficit) for r in cases] == [(1, 6.0)]
