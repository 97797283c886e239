import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import features, neighbors, series

START = dt.datetime(2024, 1, 30)
SHIFTS = {"b1": ("v", 1), "b5": ("v", 5), "a2": ("v", -2)}


@pytest.fixture(scope="module")
def sparse():
    rng = random.Random(3)
    rows = [(c, START + dt.timedelta(hours=h), float(rng.randint(0, 99)))
            for c in range(1, 8) for h in range(200) if rng.random() < (0.9 if c > 1 else 1.0)]
    return pd.DataFrame(rows, columns=["CellID", "datetime", "v"])


@pytest.fixture(scope="module")
def sparse_df(spark, sparse):
    rows = list(sparse.sample(frac=1, random_state=1).itertuples(index=False, name=None))
    rows = [(int(c), t.to_pydatetime(), v) for c, t, v in rows]
    return spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, v double").repartition(5).persist()


def expected(sparse, by):
    out = sparse.sort_values(["CellID", "datetime"] if by else ["datetime", "CellID"]).copy()
    source = out.groupby("CellID")["v"] if by else out["v"]
    for name, (_, k) in SHIFTS.items():
        out[name] = source.shift(k)
    return canonical(out)


def canonical(pdf):
    return sorted(tuple(None if x != x else x for x in r) for r in pdf[["CellID", "datetime", *SHIFTS]].itertuples(index=False, name=None))


@pytest.mark.parametrize("block_rows", [5, 6, 17, 1000])
def test_row_shifts_plain_and_blocked(sparse, sparse_df, block_rows):
    want = expected(sparse, True)
    assert canonical(series.shift_rows(sparse_df, SHIFTS).toPandas()) == want
    assert canonical(series.shift_rows_blocked(sparse_df, SHIFTS, block_rows=block_rows).toPandas()) == want


def test_whole_frame_shifts(sparse, sparse_df):
    order = ["datetime", "CellID"]
    got = series.shift_rows_blocked(sparse_df, SHIFTS, partition=[], order=order, block_rows=50)
    assert canonical(got.toPandas()) == expected(sparse, False)


def test_block_must_hold_the_largest_shift(sparse_df):
    with pytest.raises(ValueError):
        series.shift_rows_blocked(sparse_df, SHIFTS, block_rows=4)


def test_clock_shifts_need_the_exact_hour(spark):
    rows = [(1, START + dt.timedelta(hours=h), float(h)) for h in (0, 1, 3, 24)]
    df = spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, v double")
    got = series.shift_hours_aligned(df, {"l1": ("v", 1), "l24": ("v", 24), "t2": ("v", -2)}).orderBy("datetime").collect()
    assert [(r.l1, r.l24, r.t2) for r in got] == [(None, None, None), (0.0, None, 3.0), (None, None, None), (None, 0.0, None)]


def test_order_index_is_dense_with_null_times(spark):
    rows = [(None, i) for i in range(3)] + [(START + dt.timedelta(hours=h), 9) for h in range(50)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k int")
    got = series.range_index(df.repartition(7), ["t", "k"]).collect()
    assert sorted(r.row_index for r in got) == list(range(53))
    ordered = sorted(got, key=lambda r: r.row_index)
    assert [r.k for r in ordered[:3]] == [0, 1, 2] and all(a.t < b.t for a, b in zip(ordered[3:], ordered[4:]))


def test_index_of_many_and_of_no_rows(spark):
    df = spark.range(5000).select((F.hash("id") % 1000).alias("a"), "id")
    got = sorted((r.a, r.id, r.row_index) for r in series.range_index(df, ["a", "id"]).collect())
    assert [g[2] for g in got] == list(range(5000))
    assert series.range_index(df.limit(0), ["a", "id"]).count() == 0


def test_count_below_with_ties_and_missing_values(spark):
    values = [None, None] + [float(i % 7) for i in range(300)] + [3.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double").repartition(5)
    present = [v for v in values if v is not None]
    for r in series.count_below(df, "v").collect():
        assert r.n_below == (None if r.v is None else sum(v < r.v for v in present))
    assert series.count_below(df.limit(0), "v").count() == 0


def test_generic_features(spark):
    rows = [(START + dt.timedelta(hours=h), float(h)) for h in range(30)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, demand double")
    got = features.add_lag_and_seasonal_features(df, "demand", lags=(1, 24)).orderBy("timestamp").collect()
    assert [r.demand_lag_1 for r in got[:3]] == [None, 0.0, 1.0] and got[25].demand_lag_24 == 1.0
    assert got[0].day_of_week == START.weekday() and got[0].is_weekend == 0 and got[29].hour == 5


@pytest.mark.parametrize("tile", [2, 3, 16])
def test_neighbor_average_and_hits(spark, tile):
    g, rng = 11, random.Random(tile)
    rows = [(c, START + dt.timedelta(hours=h), float(rng.randint(0, 50)), f)
            for c in range(1, g * g + 1) for h in range(3) if rng.random() < 0.7 for f in ("a", "b")[: rng.randint(1, 2)]]
    df = spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, total_activity double, _source_file string")
    first = {}
    for c, t, v, f in rows:
        first.setdefault((c, t), v)

    def near(c):
        y, x = divmod(c - 1, g)
        return [(y + b) * g + x + a + 1 for a in (-1, 0, 1) for b in (-1, 0, 1)
                if (a or b) and 0 <= x + a < g and 0 <= y + b < g]

    points = neighbors.one_value_per_cell_time(df)
    totals = {(r.CellID, r.datetime): (r.nb_sum, r.nb_count)
              for r in neighbors.neighbor_totals(points, value="total_activity", grid_size=g, tile=tile).collect()}
    for (c, t) in first:
        values = [first[(n, t)] for n in near(c) if (n, t) in first]
        assert totals.get((c, t)) == ((sum(values), len(values)) if values else None)
    averaged = neighbors.with_neighbor_average(df, grid_size=g)
    assert averaged.count() == len(rows)
    for r in averaged.collect():
        values = [first[(n, r.datetime)] for n in near(r.CellID) if (n, r.datetime) in first]
        assert r.neighbor_avg_activity == (np.mean(values) if values else None) or np.isclose(r.neighbor_avg_activity, np.mean(values))
    hits = neighbors.with_neighbor_hits(df, time_col="datetime", grid_size=g, tile=tile).collect()
    assert len(hits) == len(rows)
    assert all(r.neighbors_at_risk == sum((n, r.datetime) in first for n in near(r.CellID)) for r in hits)


def test_hits_keep_cells_off_the_grid_and_separate_keys(spark):
    rows = [(1, START, 1), (2, START, 1), (2, START, 2), (999, START, 1), (None, START, 1)]
    df = spark.createDataFrame(rows, "CellID long, t timestamp_ntz, horizon int")
    got = neighbors.with_neighbor_hits(df, time_col="t", grid_size=5, keys=["horizon"]).collect()
    assert sorted((r.CellID or 0, r.horizon, r.neighbors_at_risk) for r in got) == [
        (0, 1, 0), (1, 1, 1), (2, 1, 1), (2, 2, 0), (999, 1, 0)
    ]


def test_feature_rows_and_dropped_share(spark):
    rows = [(c, START + dt.timedelta(hours=h), float(h + c)) for c in (1, 2) for h in range(40)]
    df = spark.createDataFrame(rows, "CellID long, datetime timestamp_ntz, total_activity double")
    built = features.forecast_features(df, grid_size=2, unique=True)
    kept = features.complete_rows(built)
    assert kept.count() == 2 * (40 - 24 - 4)
    row = kept.filter("CellID = 1").orderBy("datetime").first()
    assert (row.lag_24h, row.target_4h, row.baseline_1h, row.neighbor_avg_lag1h) == (1.0, 29.0, 2.0, 25.0)
    share = features.dropped_share(built).first()
    assert (share.n_rows, share.n_dropped) == (80, 56)
    by_time = features.complete_rows(features.forecast_features(df, grid_size=2, unique=True, align="time"))
    blocked = features.complete_rows(features.forecast_features(df, grid_size=2, unique=True, long_series=True))
    assert by_time.select(kept.columns).exceptAll(kept).isEmpty() and by_time.count() == kept.count()
    assert blocked.select(kept.columns).exceptAll(kept).isEmpty()
