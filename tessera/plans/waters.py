"""Standing water over the wide raster, which has several tiles from the smallest scale on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import flooding
from .embeddings import CELLS, cells, wide_heights

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Cells of a tile's side: a quarter of the raster at the smallest scales.
TILE = 128


def flood_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with the level to which water stands on it before it leaves the raster."""
    heights, box, ground = wide_heights(spark, d)
    return flooding.fill_hollows(heights, size=TILE, box=box, elsewhere=ground).select("x", "y", "filled")


def flood_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same over the small raster, whose holes drain, in tiles of 16."""
    return flooding.fill_hollows(cells(spark, d), size=16).select("x", "y", "filled")


#: Of the wide raster SQL takes minutes; tests compare with one heap.
QUERIES |= {"flood_levels": flood_levels, "flood_cells": flood_cells}
#: Levels spread inward from cells beside a gap, and again from every cell that has sunk, until none sinks.
ORACLES["flood_cells"] = f"""
with recursive {CELLS}, land as materialized (select x, y, h::double as h from cells),
around as (select dx, dy from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy) where dx <> 0 or dy <> 0),
beside as materialized (select c.x, c.y, c.h, n.x as nx, n.y as ny from land c, around join land n on n.x = c.x + dx and n.y = c.y + dy),
rim as (select x, y, any_value(h) as h from land left join (select x, y, count(*) as n from beside group by 1, 2) using (x, y) where coalesce(n, 0) < 8 group by 1, 2),
water(x, y, level) using key (x, y) as (
    select x, y, h from rim
    union
    select b.x, b.y, min(greatest(b.h, w.level)) from water w join beside b on b.nx = w.x and b.ny = w.y
        left join recurring.water r on r.x = b.x and r.y = b.y where r.level is null or greatest(b.h, w.level) < r.level group by b.x, b.y)
select x, y, level as filled from water
"""
