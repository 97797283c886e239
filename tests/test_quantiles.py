import numpy as np
import pytest

from cellgrid.operators import quantiles, thresholds


def loubar(values):
    mean, top = values.mean(), values.max()
    if top == 0 or mean == top:
        return top, 1.0
    f = min(max(1 - mean / top, 0.0), 1.0)
    return float(np.percentile(values, f * 100)), f


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(7)
    return {
        1: rng.lognormal(3, 2, 5000), 2: rng.integers(0, 5, 3000).astype(float), 3: np.full(50, 4.0),
        4: np.zeros(30), 5: np.array([3.5]), 6: np.array([1.0, 2.0]), 7: rng.normal(1e6, 1e-3, 700),
        8: np.concatenate([np.zeros(999), [1e9]]), 9: rng.uniform(0, 1, 40_000), 10: np.arange(11.0),
    }


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(1, None)]
    return spark.createDataFrame(rows, "CellID int, total_activity double").repartition(6).persist()


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 0.9, 0.98, 1.0])
def test_equals_numpy_exactly(frame, groups, fraction):
    for accuracy in (100, 10000):
        got = quantiles.group_quantile(frame, ["CellID"], "total_activity", fraction, accuracy=accuracy)
        assert {r[0]: r[1] for r in got.collect()} == {g: float(np.quantile(v, fraction)) for g, v in groups.items()}


def test_builtin_form_agrees(frame, groups):
    got = quantiles.group_quantile(frame, ["CellID"], "total_activity", 0.9, sketch=False)
    for r in got.collect():
        assert np.isclose(r[1], np.quantile(groups[r[0]], 0.9), rtol=1e-12)


def test_mean_to_max_rule(frame, groups):
    for r in thresholds.mean_to_max_thresholds(frame).collect():
        threshold, f_star = loubar(groups[r.CellID])
        # The mean is a float sum whose order differs, so F* may differ in its last bits.
        assert np.isclose(r.loubar_f_star, f_star, rtol=1e-9), r
        assert np.isclose(r.loubar_threshold, threshold, rtol=1e-9, atol=1e-9), r


def test_hot_group_and_flags(spark):
    """One group with most rows gives the same result, and about a tenth of it is flagged."""
    df = spark.range(60_000).selectExpr(
        "IF(id % 10 < 8, 0, id % 10) AS CellID", "cast(pmod(id * 7919, 60013) AS double) AS total_activity"
    )
    flagged = thresholds.flag_congestion(df)
    pdf = df.toPandas()
    expected = pdf.groupby("CellID")["total_activity"].quantile(0.9).to_dict()
    got = {r.CellID: r.congestion_threshold for r in flagged.select("CellID", "congestion_threshold").distinct().collect()}
    assert got == expected
    assert abs(thresholds.flag_rate(flagged).first().flagged_pct - 10) < 0.1
    assert flagged.count() == 60_000


def test_as_of_uses_earlier_rows_only(spark):
    df = spark.createDataFrame(
        [(1, f"2024-01-0{d} 00:00:00", float(d)) for d in range(1, 7)], "CellID int, datetime string, total_activity double"
    ).selectExpr("CellID", "cast(datetime AS timestamp_ntz) AS datetime", "total_activity")
    got = thresholds.percentile_thresholds(df, percentile=100, as_of="2024-01-04 00:00:00")
    assert got.first().congestion_threshold == 3.0
