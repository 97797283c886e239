"""Column arithmetic on a square lattice of cells numbered row by row from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import GRID_SIZE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell_x(cell: Column | str, grid_size: int = GRID_SIZE) -> Column:
    return F.pmod(_col(cell) - 1, F.lit(grid_size)) + 1


def cell_y(cell: Column | str, grid_size: int = GRID_SIZE) -> Column:
    return F.floor((_col(cell) - 1) / F.lit(grid_size)) + 1


def cell_at(x: Column | str, y: Column | str, grid_size: int = GRID_SIZE) -> Column:
    return (_col(y) - 1) * grid_size + _col(x)


def on_grid(cell: Column | str, grid_size: int = GRID_SIZE) -> Column:
    return _col(cell).between(1, grid_size * grid_size)


def neighbor_total(cell: Column | str, grid_size: int = GRID_SIZE) -> Column:
    """How many of the eight surrounding positions lie on the grid (8, 5 or 3 on a large grid)."""

    def span(c: Column) -> Column:
        return F.least(c + 1, F.lit(grid_size)) - F.greatest(c - 1, F.lit(1)) + 1

    return span(cell_x(cell, grid_size)) * span(cell_y(cell, grid_size)) - 1


# Offsets of the surrounding positions, column by column; their rank is the order of neighbours.
OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def neighbor_ids(cell: Column | str, grid_size: int = GRID_SIZE) -> Column:
    """Array of the eight surrounding cells in order; NULL stands for a position off the grid."""
    x, y = cell_x(cell, grid_size), cell_y(cell, grid_size)
    return F.array(
        *[
            F.when(
                (x + dx).between(1, grid_size) & (y + dy).between(1, grid_size),
                (_col(cell) + dy * grid_size + dx).cast("long"),
            )
            for dx, dy in OFFSETS
        ]
    )


def spread_to_neighbors(df: DataFrame, cell: str, grid_size: int = GRID_SIZE) -> DataFrame:
    """One row per row and neighbour on the grid, with ``pos`` and ``neighbor`` added.

    The offsets are a constant array and the rest is arithmetic, so it all stays in generated code.
    """
    offsets = F.array(
        *[F.struct(F.lit(p).alias("pos"), F.lit(dx).alias("_dx"), F.lit(dy).alias("_dy")) for p, (dx, dy) in enumerate(OFFSETS)]
    )
    placed = df.filter(on_grid(cell, grid_size)).withColumns(
        {"_x": cell_x(cell, grid_size), "_y": cell_y(cell, grid_size)}
    )
    spread = placed.select("*", F.inline(offsets)).filter(
        (F.col("_x") + F.col("_dx")).between(1, grid_size) & (F.col("_y") + F.col("_dy")).between(1, grid_size)
    )
    neighbor = (F.col(cell) + F.col("_dy") * grid_size + F.col("_dx")).cast("long")
    return spread.select(*df.columns, "pos", neighbor.alias("neighbor"))


def tile_of(x: Column, y: Column, tile: int, grid_size: int) -> Column:
    """Number of the ``tile`` x ``tile`` block that holds position (x, y)."""
    per_row = -(-grid_size // tile)
    return F.floor((y - 1) / tile) * per_row + F.floor((x - 1) / tile)


def tiles_touched(cell: Column | str, tile: int, grid_size: int = GRID_SIZE) -> Column:
    """Tiles that contain the cell or one of its neighbours: one inside a tile, at most four at a corner."""
    x, y = cell_x(cell, grid_size), cell_y(cell, grid_size)

    def low(c: Column) -> Column:
        return F.greatest(c - 1, F.lit(1))

    def high(c: Column) -> Column:
        return F.least(c + 1, F.lit(grid_size))

    return F.array_distinct(
        F.array(*[tile_of(a(x), b(y), tile, grid_size) for a in (low, high) for b in (low, high)])
    )
