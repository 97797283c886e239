import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import features, forecast, reports, serving, validation
from cellgrid.plans import event_panel as ep
from cellgrid.session import materialise

from .conftest import TESTDATA

T0 = dt.datetime(2024, 3, 10, 12)


@pytest.fixture(scope="module")
def split(spark):
    panel = ep.staged_panel(spark, f"{TESTDATA}/sf0.01")
    rows = features.complete_rows(features.forecast_features(panel, order=ep.UNIQUE_ORDER, grid_size=ep.GRID))
    matrix = materialise(rows, "matrix")
    return matrix, *forecast.chronological_split(matrix)


def test_split_is_chronological(split):
    matrix, train, test = split
    cutoff = matrix.agg(F.min("datetime")).first()[0] + dt.timedelta(days=5)
    assert train.agg(F.max("datetime")).first()[0] < cutoff <= test.agg(F.min("datetime")).first()[0]
    assert train.count() + test.count() == matrix.count()
    assert test.filter("cell_historical_mean IS NULL").isEmpty()
    shorter, _ = forecast.chronological_split(matrix, embargo_hours=4)
    assert shorter.agg(F.max("datetime")).first()[0] < cutoff - dt.timedelta(hours=4)


def test_unseen_cell_gets_the_overall_mean(spark):
    rows = [(1, dt.datetime(2024, 1, d), float(d)) for d in range(1, 10)] + [(2, dt.datetime(2024, 1, 9), 5.0)]
    df = spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, total_activity double")
    _, test = forecast.chronological_split(df)
    assert {r.CellID: r.cell_historical_mean for r in test.collect()} == {1: 3.0, 2: 3.0}


def test_trees_are_deterministic_and_not_negative(spark, split):
    _, train, test = split
    train, test = materialise(train), materialise(test)
    runs = []
    for _ in range(2):
        models = forecast.fit_horizons(train, (1, 4), grid_size=ep.GRID, trees=3)
        scored = materialise(forecast.predict_horizons(test, models, grid_size=ep.GRID))
        assert scored.filter("prediction_1h < 0 OR prediction_4h < 0 OR prediction_1h IS NULL").isEmpty()
        runs.append(sorted(map(tuple, forecast.evaluate(scored, (1, 4)).collect())))
    assert runs[0] == runs[1] and {r[1] for r in runs[0]} == {"All cells", "Typical cells", "Hotspot cells (top 2%)"}
    top = forecast.top_importances(models, spark).collect()
    assert len(top) == 12 and all(r.importance >= 0 for r in top)


def test_scorer_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    for model in (None, object()):
        with pytest.raises(TypeError):
            forecast.score_with(df, model, ["a"])

    class Plus:
        def predict(self, frame):
            return frame["a"] + frame["b"]

    assert forecast.score_with(df, Plus(), ["a", "b"]).first().prediction == 3.0


CASES = "CellID long, target_datetime_1h timestamp_ntz, naive_forecast_1h double, congestion_threshold double, classification string, reason string"


@pytest.fixture(scope="module")
def tables(spark):
    diagnosed = spark.createDataFrame(
        [(2, T0, 20.0, 10.0, "ROUTINE", "2/8 x"), (1, T0, 13.0, 10.0, "ROUTINE", "target date is a known holiday"),
         (1, T0 - dt.timedelta(hours=1), None, None, "ANOMALOUS", "isolated")], CASES)
    covered = spark.createDataFrame(
        [(2, T0, 10.0, 7.5, False), (1, T0, 3.0, 0.0, False)],
        "CellID long, target_datetime timestamp_ntz, deficit double, covered double, fully_resolved boolean")
    moves = spark.createDataFrame(
        [(T0, 2, 12, 2.5), (T0, 2, 3, 5.0), (T0, 99, 98, 1.0)],
        "target_datetime timestamp_ntz, congested_cell long, source_cell long, amount_moved double")
    return diagnosed, covered, moves


def test_report_texts(tables):
    built = reports.with_reports(reports.assemble_cases(*tables, grid_size=10))
    got = {(r.CellID, r.target_datetime): r.report for r in built.collect()}
    assert got[(2, T0)] == (
        "[MOCK] Cell 2 is forecasted to exceed its normal traffic threshold at 2024-03-10 12:00:00 (2/8 x). "
        "Recommended action: 2.5 units from Cell 12, 5.0 units from Cell 3. This covers 75% of the predicted deficit. "
        "Classified ROUTINE — safe for automatic handling, logged for audit.")
    assert "no reallocation possible — insufficient nearby spare capacity. This covers 0%" in got[(1, T0)]
    assert got[(1, T0 - dt.timedelta(hours=1))] == (
        "[MOCK] Cell 1 is forecasted to exceed its normal traffic threshold at 2024-03-10 11:00:00, but this does not "
        "match a routine, explainable pattern (isolated). No automatic reallocation was attempted. "
        "ESCALATED — recommend manual investigation before any action is taken.")
    bare = reports.with_reports(reports.assemble_cases(tables[0], None, None)).filter("CellID = 2").first()
    assert "covers 0% of" in bare.report and bare.sources == []


def test_serving_queries(spark, tables):
    t = {n: materialise(df) for n, df in serving.build_serving_tables(*tables, grid_size=10).items()}
    cases = {r.id: r for r in t["cases"].collect()}
    assert [(cases[i].cell_id, cases[i].target_datetime) for i in (1, 2, 3)] == [
        (1, T0 - dt.timedelta(hours=1)), (1, T0), (2, T0)]
    assert (cases[1].naive_forecast, cases[1].deficit, cases[1].fully_resolved) == (0.0, None, None)
    assert [(r.id, r.case_id, r.source_cell_id) for r in t["sources"].orderBy("id").collect()] == [(1, 3, 12), (2, 3, 3)]

    texts = serving.generate_reports(t["cases"], t["sources"], [3])
    first = materialise(reports.upsert_reports(t["reports"], texts, now=F.lit("2024-01-01").cast("timestamp_ntz")))
    assert [(r.id, r.case_id) for r in first.collect()] == [(1, 3)]
    later = F.lit("2024-02-02").cast("timestamp_ntz")
    everything = serving.generate_reports(t["cases"], t["sources"])
    second = reports.upsert_reports(first, everything, now=later).orderBy("id").collect()
    assert [(r.id, r.case_id, r.generated_at.month) for r in second] == [(1, 3, 1), (2, 1, 2), (3, 2, 2)]
    renewed = reports.upsert_reports(first, everything, now=later, refresh=True)
    assert {r.generated_at.month for r in renewed.collect()} == {2}

    listed = serving.list_cases(t["cases"], first, limit=2).collect()
    assert [(r.id, r.has_report) for r in listed] == [(1, False), (2, False)]
    routine = serving.list_cases(t["cases"], first, "Routine")
    assert [(r.id, r.has_report) for r in routine.collect()] == [(2, False), (3, True)]
    detail = serving.get_case(t["cases"], t["sources"], first, 3).first()
    assert [s.source_cell_id for s in detail.sources] == [12, 3] and detail.report.report_text.startswith("[MOCK] Cell 2")
    assert serving.get_case(t["cases"], t["sources"], first, 1).first().report is None
    with pytest.raises(LookupError):
        serving.get_case(t["cases"], t["sources"], first, 77)
    assert [r.case_id for r in serving.list_reports(t["cases"], first).collect()] == [3]
    shown = {r.Cell: r for r in serving.case_display(routine).collect()}
    assert (shown[2]["Report?"], shown[2]["Fully Resolved?"], shown[2].label) == (
        "Yes", "No", "Cell 2 @ 2024-03-10 12:00:00 (id 3)")


def test_first_cases_per_class_limit_before_the_exchange(spark):
    df = spark.range(1000).selectExpr(
        "id AS CellID", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS target_datetime", "IF(id % 3 = 0, 'A', 'B') AS classification")
    got = reports.first_per_class(df.repartition(5))
    assert sorted((r.classification, r.CellID) for r in got.collect()) == [
        ("A", 0), ("A", 3), ("A", 6), ("B", 1), ("B", 2), ("B", 4)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_known_patterns(spark):
    rows = []
    for c in range(1, 21):
        for h in range(24 * 7):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
            weekend, evening = t.weekday() >= 5, t.hour >= 18
            rows.append((c, t, 10.0 * c - (5 if weekend and c == 3 else 0), 9.0 if evening and c == 4 else 1.0))
    df = spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, total_activity double, internet double")
    report = {r.check: r for r in validation.known_pattern_report(df, university=3, nightlife=4, centre=20).collect()}
    assert {k: r.status for k, r in report.items()} == {
        "weekend_lower": "PASS", "evening_higher": "PASS", "centre_high": "PASS"}
    assert report["centre_high"].b == 95.0
    weak = {r.check: r.status for r in validation.known_pattern_report(
        df.drop("internet"), university=5, nightlife=4, centre=10).collect()}
    assert weak == {"weekend_lower": "UNEXPECTED", "evening_higher": "NO COLUMN", "centre_high": "WEAKER THAN EXPECTED"}
    none = validation.known_pattern_report(df, university=77, nightlife=77, centre=77).collect()
    assert {r.status for r in none} == {"NO ROWS"}
