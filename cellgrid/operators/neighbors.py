"""Aggregates over the eight surrounding cells, computed tile by tile.

Sending every value to its eight neighbours through the shuffle would multiply the data by
eight. Instead each row goes to the tile of the grid that holds it, and rows at a tile border
also to the adjacent tiles (about a quarter more rows with 16 x 16 tiles). The fan-out to
neighbours and its aggregation then happen inside the task, without another exchange. A
(tile, time) group holds at most 18 x 18 points, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import GRID_SIZE
from ..functions.grid import cell_x, cell_y, neighbor_ids, on_grid, spread_to_neighbors, tile_of, tiles_touched

TILE = 16
# Smaller tiles where a window hands the cells of its tile to every row.
HIT_TILE = 8


def neighbor_totals(
    points: DataFrame,
    *,
    value: str,
    cell_col: str = "CellID",
    time_col: str = "datetime",
    grid_size: int = GRID_SIZE,
    tile: int = TILE,
) -> DataFrame:
    """Sum and number of the neighbours' values around every cell that has a neighbour with a row.

    ``points`` has at most one row per (cell, time). Returns cell, time, ``nb_sum``, ``nb_count``.
    """
    placed = (
        points.select(cell_col, time_col, F.col(value).alias("_v"))
        .filter(on_grid(cell_col, grid_size) & F.col("_v").isNotNull())
        .withColumn("_tile", F.explode(tiles_touched(cell_col, tile, grid_size)))
        .repartition("_tile", time_col)
    )
    spread = spread_to_neighbors(placed, cell_col, grid_size).withColumnRenamed("neighbor", "_to")
    # A contribution counts only in the tile that owns its target, so border copies count once.
    owner = tile_of(cell_x("_to", grid_size), cell_y("_to", grid_size), tile, grid_size)
    return (
        spread.filter(owner == F.col("_tile"))
        .groupBy("_tile", time_col, "_to")
        .agg(F.sum("_v").alias("nb_sum"), F.count("_v").alias("nb_count"))
        .select(F.col("_to").alias(cell_col), time_col, "nb_sum", "nb_count")
    )


def one_value_per_cell_time(
    df: DataFrame,
    *,
    value: str = "total_activity",
    cell_col: str = "CellID",
    time_col: str = "datetime",
    tie_break: str | None = "_source_file",
) -> DataFrame:
    """The cell's value at each time; where several files have it, the one of the first file."""
    keyed = df.filter(F.col(value).isNotNull()).groupBy(cell_col, time_col)
    if tie_break and tie_break in df.columns:
        return keyed.agg(F.min_by(value, tie_break).alias(value))
    return keyed.agg(F.min(value).alias(value))


def with_neighbor_average(
    df: DataFrame,
    *,
    value: str = "total_activity",
    name: str = "neighbor_avg_activity",
    cell_col: str = "CellID",
    time_col: str = "datetime",
    grid_size: int = GRID_SIZE,
    unique: bool = False,
) -> DataFrame:
    """Attach the mean of ``value`` over the neighbours that have a row at the same time (NULL if none).

    ``unique=True`` states that (cell, time) is already unique and saves one aggregation.
    """
    points = df if unique else one_value_per_cell_time(df, value=value, cell_col=cell_col, time_col=time_col)
    totals = neighbor_totals(
        points, value=value, cell_col=cell_col, time_col=time_col, grid_size=grid_size
    ).select(cell_col, time_col, (F.col("nb_sum") / F.col("nb_count")).alias(name))
    return df.join(totals, [cell_col, time_col], "left")


def with_neighbor_hits(
    df: DataFrame,
    *,
    name: str = "neighbors_at_risk",
    cell_col: str = "CellID",
    time_col: str = "target_hour_key",
    grid_size: int = GRID_SIZE,
    tile: int = HIT_TILE,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Attach to every row how many of its neighbours also have a row in ``df`` at the same time
    (and with the same ``keys``).

    One exchange: each row meets the cells of its tile and time in a window, whose set of
    cells holds at most 10 x 10 numbers. Nothing is joined, so ``df`` is computed once.
    """
    x, y = cell_x(cell_col, grid_size), cell_y(cell_col, grid_size)
    home = F.when(on_grid(cell_col, grid_size), tile_of(x, y, tile, grid_size))
    touched = F.when(on_grid(cell_col, grid_size), tiles_touched(cell_col, tile, grid_size))
    # A cell off the grid has no neighbours and is nobody's neighbour; its row is kept.
    copies = df.select("*", home.alias("_home"), F.explode_outer(touched).alias("_tile"))
    together = Window.partitionBy("_tile", time_col, *keys, F.when(F.col("_tile").isNull(), F.col(cell_col)))
    present = copies.withColumn("_cells", F.collect_set(cell_col).over(together))
    hits = F.when(F.col("_home").isNull(), F.lit(0)).otherwise(
        F.size(F.array_intersect(neighbor_ids(cell_col, grid_size), "_cells"))
    )
    return (
        present.filter(F.col("_home").eqNullSafe(F.col("_tile")))
        .withColumn(name, hits.cast("long"))
        .drop("_home", "_tile", "_cells")
    )


def neighbor_rows(
    df: DataFrame, *, cell_col: str = "CellID", grid_size: int = GRID_SIZE
) -> DataFrame:
    """One row per row of ``df`` and neighbour on the grid, with ``pos`` and ``neighbor``."""
    return spread_to_neighbors(df, cell_col, grid_size)
