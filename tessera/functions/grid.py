"""Quadtree tile addressing as pure Column expressions.

Tiles are 512 texels square; x grows east and y grows south, both signed.  The
lattice hangs on the projection's origin, so neighbouring rasters align.
Floors, arithmetic shifts and ``pmod`` throughout: truncation would be wrong
left of and above the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
Num = Column | int | float


def _c(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def metres_per_texel(level: Num, base: Num = 1.0) -> Column:
    return _c(base) * F.pow(F.lit(2.0), _c(level))


def tile_span(level: Num, base: Num = 1.0) -> Column:
    return metres_per_texel(level, base) * TILE


def tile_of_metres(level: Num, easting: Num, northing: Num, base: Num = 1.0) -> tuple[Column, Column]:
    span = tile_span(level, base)
    return F.floor(_c(easting) / span).cast("int"), F.floor(-_c(northing) / span).cast("int")


def tile_origin_metres(level: Num, tx: Num, ty: Num, base: Num = 1.0) -> tuple[Column, Column]:
    span = tile_span(level, base)
    return _c(tx) * span, -_c(ty) * span


def tile_path(level: Num, tx: Num, ty: Num) -> Column:
    return F.format_string("%02d/%d_%d.tif", _c(level), _c(tx), _c(ty))


def parent(t: Num, steps: int = 1) -> Column:
    return F.shiftright(_c(t), steps)


def children(df: DataFrame, tx: str = "tx", ty: str = "ty") -> DataFrame:
    """Four rows a tile, in reading order, as child (0..3), cx, cy."""
    four = F.array(*(F.struct(F.lit(k).alias("child"), (F.col(tx) * 2 + k % 2).alias("cx"), (F.col(ty) * 2 + k // 2).alias("cy")) for k in range(4)))
    return df.select("*", F.inline(four))


def ancestors(df: DataFrame, levels: int, tx: str = "tx", ty: str = "ty") -> DataFrame:
    """A row for each tile and each of ``levels`` steps up, as up, ax, ay."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    return df.select("*", up.alias("up")).withColumn("ax", F.expr(f"shiftright({tx}, up)")).withColumn("ay", F.expr(f"shiftright({ty}, up)"))


def size_at(extent: Num, level: str) -> Column:
    return F.greatest(F.expr(f"shiftright({extent}, {level})"), F.lit(1))


def origin_texels(easting: Num, northing: Num, metres: Num) -> tuple[Column, Column]:
    return F.round(_c(easting) / _c(metres)).cast("long"), -F.round(_c(northing) / _c(metres)).cast("long")


def tile_of_texel(column: Num, row: Num) -> tuple[Column, Column, Column, Column]:
    """Tile and position within it of a lattice texel."""
    c, r = _c(column), _c(row)
    return F.floor(c / TILE).cast("long"), F.floor(r / TILE).cast("long"), F.pmod(c, F.lit(TILE)), F.pmod(r, F.lit(TILE))


def texel_centre(corner: Num, index: Num, metres: Num) -> Column:
    return _c(corner) + (_c(index) + 0.5) * _c(metres)


def world_of_texel(column: Num, row: Num, width: Num, height: Num, metres: Num) -> tuple[Column, Column]:
    """East and south of the raster's centre; all levels share the level-0 half texel."""
    return (_c(column) + 0.5 - _c(width) / 2) * _c(metres), (_c(row) + 0.5 - _c(height) / 2) * _c(metres)


def texel_of_world(x: Num, z: Num, width: Num, height: Num, metres: Num) -> tuple[Column, Column]:
    return _c(x) / _c(metres) + _c(width) / 2 - 0.5, _c(z) / _c(metres) + _c(height) / 2 - 0.5


def snap_outward(low: Num, high: Num, unit: float = 8192.0) -> tuple[Column, Column]:
    """First and last-plus-one unit that cover an interval, one at least."""
    first = F.floor(_c(low) / unit)
    return first, F.greatest(F.ceil(_c(high) / unit), first + 1)


def aligns_with(metres_a: Num, origin_a: Num, metres_b: Num, origin_b: Num) -> Column:
    """Same scale, and origins a whole number of texels apart within a thousandth."""
    apart = (_c(origin_a) - _c(origin_b)) / _c(metres_a)
    return (_c(metres_a) == _c(metres_b)) & (F.abs(apart - F.round(apart)) <= 1e-3)


def block_key(t: Num, first: Num, n: int) -> Column:
    """Which block of n tiles a tile of an extent falls into."""
    return F.floor((_c(t) - _c(first)) / n).cast("long")


def stored_level(level: Num, base: Num, top: Num) -> tuple[Column, Column]:
    """The stored level that answers for one asked for, and the magnification."""
    at = F.least(F.greatest(_c(level), _c(base)), _c(top))
    return at, F.shiftleft(F.lit(1), (at - _c(level)).cast("int")) if isinstance(level, int) else F.pow(F.lit(2), F.greatest(at - _c(level), F.lit(0))).cast("int")


def in_tiles(df: DataFrame, x: str, y: str, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Rows of a texel window, as plain comparisons, which reach the Parquet scan."""
    return df.where(F.col(x).between(x0, x1 - 1) & F.col(y).between(y0, y1 - 1))


def strip_runs(df: DataFrame, index: str = "i", *by: str) -> DataFrame:
    """Runs of texel indices within a tile: tile, first, last, n."""
    return df.groupBy(*by, F.floor(F.col(index) / TILE).cast("long").alias("tile")).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))


def pixel_angle(fov_y: float, rows: int) -> float:
    return fov_y / rows


def detail_level(distance: Num, angle: Num, metres: Num = 1.0) -> Column:
    """The finest level worth reading: log2 of the texels that a pixel covers."""
    return F.floor(F.log2(F.greatest(_c(distance) * _c(angle) / _c(metres), F.lit(1.0)))).cast("int")


def tile_range(level: Num, west: Num, north: Num, width: Num, height: Num, base: Num = 1.0) -> tuple[Column, Column, Column, Column]:
    """(tx, ty, across, down) of the tiles that an extent touches; half a texel inside its far edges, so that none beyond counts."""
    inside = _c(base) * 0.5
    tx, ty = tile_of_metres(level, west, north, base)
    lx, ly = tile_of_metres(level, _c(west) + _c(width) - inside, _c(north) - _c(height) + inside, base)
    return tx, ty, lx - tx + 1, ly - ty + 1


def fitting_degrees(width: Num, height: Num, tiles: Num, most: int) -> Column:
    """The shorter side of a box, shrunk so that its tiles would number ``most``."""
    return F.greatest(F.least(_c(width), _c(height)), F.lit(0.0)) * F.sqrt(F.lit(float(most)) / F.greatest(_c(tiles), F.lit(1)))
