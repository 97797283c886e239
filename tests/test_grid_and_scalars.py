import math

from pyspark.sql import functions as F

from cellgrid.functions import grid, scalars
from cellgrid.operators import dispatch, neighbors

CORNERS = {1: 3, 100: 3, 9901: 3, 10000: 3, 50: 5, 5050: 8}


def around(cell, g=100):
    y, x = divmod(cell - 1, g)
    return {
        (y + dy) * g + x + dx + 1
        for dx in (-1, 0, 1) for dy in (-1, 0, 1)
        if (dx or dy) and 0 <= x + dx < g and 0 <= y + dy < g
    }


def test_corner_edge_and_inner_cells(spark):
    df = spark.createDataFrame([(c,) for c in CORNERS], "cell long")
    totals = {r[0]: r[1] for r in df.select("cell", grid.neighbor_total("cell")).collect()}
    assert totals == CORNERS
    found = {}
    for r in neighbors.neighbor_rows(df, cell_col="cell").collect():
        found.setdefault(r.cell, set()).add(r.neighbor)
    assert found == {c: around(c) for c in CORNERS}


def test_positions_round_trip_and_adjacency_is_symmetric(spark):
    cells = spark.range(1, 26 * 26 + 1).withColumnRenamed("id", "cell")
    g = 26
    again = cells.select("cell", grid.cell_at(grid.cell_x("cell", g), grid.cell_y("cell", g), g).alias("again"))
    assert again.filter("cell <> again").isEmpty()
    pairs = neighbors.neighbor_rows(cells, cell_col="cell", grid_size=g).select("cell", "neighbor")
    swapped = pairs.select(F.col("neighbor").alias("cell"), F.col("cell").alias("neighbor"))
    assert pairs.exceptAll(swapped).isEmpty()


def test_cells_off_the_grid_have_no_neighbors(spark):
    df = spark.createDataFrame([(0,), (-7,), (10001,)], "cell long")
    assert neighbors.neighbor_rows(df, cell_col="cell").isEmpty()


def test_number_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("",), ("abc",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.to_number("t")).collect()] == [1.5, 2.0, None, None, None, None]


def test_total_skips_missing(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id int, smsin double, internet double")
    rows = scalars.with_total_activity(df).orderBy("id").collect()
    assert [r.total_activity for r in rows] == [2.0, 0.0]
    kept = scalars.with_total_activity(df.withColumn("total_activity", F.lit(9.0)), only_if_absent=True)
    assert kept.first().total_activity == 9.0


def test_missing_side_is_not_at_risk(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(scalars.exceeds("a", "b")).collect()] == [True, False, False, False]


def test_fixed_decimals_follow_the_binary_value(spark):
    values = [0.25, 0.15, 0.35, 2.5, 0.5, 1.5, 0.05, 99.95, 1234567.25, 1e9 + 0.45, 0.0, 12.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", scalars.fixed_decimals("v", 1).alias("one"), scalars.fixed_decimals("v", 0).alias("none"),
                     scalars.round_binary("v", 1).alias("r")).collect()
    for r in rows:
        assert (r.one, r.none, r.r) == (f"{r.v:.1f}", f"{r.v:.0f}", round(r.v, 1))


def test_log_scale_is_clipped_at_zero(spark):
    df = spark.createDataFrame([(5.0,), (-3.0,)], "v double")
    got = [r[0] for r in df.select(scalars.from_log_scale("v")).collect()]
    assert math.isclose(got[0], math.expm1(5)) and got[1] == 0.0


def test_shortfall_and_residual(spark):
    df = spark.createDataFrame([([10, 5], [8, 7])], "d array<int>, s array<int>")
    assert df.select(dispatch.array_shortfall("d", "s")).first()[0] == [2, 0]
    one = spark.createDataFrame([(10, 10, 1), (10, 12, 1)], "f int, a int, t int")
    assert [r[0] for r in one.select(dispatch.residual_status("f", "a", "t")).collect()] == ["ok", "deviation"]
