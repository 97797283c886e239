import datetime as dt
import random

import numpy as np
import pytest

from cellgrid.operators.quantiles import whole_quantiles
from cellgrid.operators.threshold_state import ThresholdState, rank_error, threshold_errors

START = dt.datetime(2024, 3, 1)
SCHEMA = "CellID long, datetime timestamp_ntz, total_activity double"


def rows_of(days, seed=1, per_day=200):
    rng = random.Random(seed)
    return [(c, START + dt.timedelta(days=d, minutes=7 * i), rng.choice([rng.random(), float(rng.randrange(5)), rng.gauss(5, 2)]))
            for d in days for c in (1, 2) for i in range(per_day)]


def exact(rows, first, last, q=0.9):
    out = {}
    for c in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == c and r[2] is not None and r[1] is not None and first <= r[1].date() <= last]
        if v:
            out[c] = float(np.quantile(v, q))
    return out


def test_windows_need_no_rescan_and_days_are_replaced(spark, tmp_path):
    state = ThresholdState(spark, str(tmp_path / "s"), size=64)
    with pytest.raises(ValueError):
        state.merged()
    rows = rows_of(range(6)) + [(3, START, None), (3, None, 1.0), (1, START, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    state.add(df.where("datetime < '2024-03-04'"))
    state.add(df.where("datetime >= '2024-03-03'"))  # the third day once more
    for a, b in ((0, 5), (2, 3), (4, 4)):
        first, last = (START + dt.timedelta(days=d) for d in (a, b))
        first, last = first.date(), last.date()
        found = state.thresholds(first, last)
        window = df.where(f"to_date(datetime) between '{first}' and '{last}'")
        for r in threshold_errors(window, found).collect():
            assert r.n == 200 * (b - a + 1) and r.rank_error <= rank_error(64) + 1 / r.n
        got = {r.CellID: r.congestion_threshold for r in state.exact_thresholds(df, first, last).collect()}
        want = exact(rows, first, last)
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    assert {r.day for r in state.days().select("day").distinct().collect()} == {(START + dt.timedelta(days=d)).date() for d in range(6)}


def test_a_changed_day_changes_the_threshold(spark, tmp_path):
    state = ThresholdState(spark, str(tmp_path / "s"))
    low = [(1, START + dt.timedelta(hours=h), 1.0) for h in range(10)]
    state.add(spark.createDataFrame(low, SCHEMA))
    state.add(spark.createDataFrame([(c, t, 9.0) for c, t, _ in low], SCHEMA))
    assert [(r.n, r.congestion_threshold) for r in state.thresholds().collect()] == [(10, 9.0)]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 50 + [1.0, None], [float((i * 37) % 101) for i in range(500)], [None], []])
def test_whole_quantiles_with_weights(spark, values):
    rows = [(v, i % 4) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v double, w int").repartition(6)
    for weight in (None, "w"):
        flat = [v for v, w in rows if v is not None for _ in range(1 if weight is None else w)]
        got = whole_quantiles(df, "v", (0.0, 0.25, 0.98, 1.0), weight=weight).collect()
        assert len(got) == 1
        if not flat:
            assert set(got[0]) == {None}
        else:
            assert np.allclose(list(got[0]), np.quantile(flat, (0.0, 0.25, 0.98, 1.0)))
