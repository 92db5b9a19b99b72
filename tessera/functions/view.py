"""Pixels, rays and depths of a camera; what a frame takes over from the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .noise import bayer_rank

# Sub-pixel steps of a packed offset, the largest offset, how much nearer an occluder is, and cells dropped of 64.
OFFSET_SCALE, OFFSET_MOST = 256.0, 0.99609375
OCCLUDER_NEARER = 2.0
DROPPED = 19
#: Bytes of a resident texel: height, material, ceiling.
TEXEL_BYTES = 10
MAX_TILES_ACROSS = 16

Vector = tuple[float, float, float]


@dataclass(frozen=True)
class Camera:
    """Eye, basis (right and up reach the screen's edges at unit distance) and near plane; depth is ``near`` over the distance along ``forward``."""

    eye: Vector
    right: Vector
    up: Vector
    forward: Vector
    near: float
    width: int
    height: int

    def ray(self, px: Column, py: Column) -> tuple[Column, Column, Column]:
        """The ray through a place of the screen, one unit along the view axis."""
        u, v = px / self.width * 2 - 1, 1 - py / self.height * 2
        return tuple(r * u + t * v + f for r, t, f in zip(self.right, self.up, self.forward, strict=True))

    def distance(self, depth: Column) -> Column:
        return F.try_divide(F.lit(self.near), depth)

    def depth(self, distance: Column) -> Column:
        return F.try_divide(F.lit(self.near), distance)

    def place(self, px: Column, py: Column, depth: Column) -> tuple[Column, Column, Column]:
        """The point of the world that a place of the screen shows at a depth."""
        return tuple(e + r * self.distance(depth) for e, r in zip(self.eye, self.ray(px, py), strict=True))

    def screen(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """(px, py, distance along the view axis) of a point; px and py are null behind the eye."""
        rel = [p - e for p, e in zip((x, y, z), self.eye, strict=True)]
        dot = lambda v: rel[0] * v[0] + rel[1] * v[1] + rel[2] * v[2]
        square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
        ahead = dot(self.forward) / square(self.forward)
        seen = ahead > 0
        u, v = F.try_divide(dot(self.right) / square(self.right), ahead), F.try_divide(dot(self.up) / square(self.up), ahead)
        return F.when(seen, (u * 0.5 + 0.5) * self.width), F.when(seen, (0.5 - v * 0.5) * self.height), ahead


def normalised(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    size = F.sqrt(x * x + y * y + z * z)
    return x / size, y / size, z / size


def offset_step(v: Column) -> Column:
    """A place inside a pixel in 256 steps."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(OFFSET_MOST)) * OFFSET_SCALE).cast("int")


def motion(px: Column, py: Column, depth: Column, now: Camera, was: Camera) -> tuple[Column, Column]:
    """How far a pixel's ground moved on the screen; zero for sky (depth 0) and for what was behind the eye."""
    cx, cy = px + 0.5, py + 0.5
    wx, wy, _ = was.screen(*now.place(cx, cy, F.when(depth != 0, depth)))
    return F.coalesce(cx - wx, F.lit(0.0)), F.coalesce(cy - wy, F.lit(0.0))


def _once(**named: Column) -> Column:
    """Columns that later expressions refer to instead of repeating: a generated row is not merged into what reads it."""
    return F.inline(F.array(F.struct(*(v.alias(k) for k, v in named.items()))))


def carry(frame: DataFrame, was: Camera, now: Camera) -> DataFrame:
    """px, py, ox, oy, depth, material of the pixels of ``now`` that points of the last frame land on; of several the nearest wins, then the larger material.

    ``frame``: px, py, ox, oy (offsets in 256 steps), depth (0: sky, not carried), material.
    """
    seen = frame.where("depth > 0")
    point = was.place(F.col("px") + F.col("ox") / OFFSET_SCALE, F.col("py") + F.col("oy") / OFFSET_SCALE, F.col("depth"))
    seen = seen.select("material", _once(x=point[0], y=point[1], z=point[2]))
    x, y, ahead = now.screen(F.col("x"), F.col("y"), F.col("z"))
    landed = seen.select("material", _once(lx=x, ly=y, depth=now.depth(ahead)))
    landed = landed.where((F.col("lx") >= 0) & (F.col("lx") < now.width) & (F.col("ly") >= 0) & (F.col("ly") < now.height))
    px, py = F.floor("lx"), F.floor("ly")
    landed = landed.select(px.alias("px"), py.alias("py"), offset_step(F.col("lx") - px).alias("ox"), offset_step(F.col("ly") - py).alias("oy"), "depth", "material")
    best = F.max(F.struct("depth", "material", "ox", "oy")).alias("b")
    return landed.groupBy("px", "py").agg(best).select("px", "py", "b.ox", "b.oy", "b.depth", "b.material")


def swept(mine: Column, intruder: Column, moved: Column) -> Column:
    """Whether something much nearer passed through a pixel's cell since the last frame."""
    return moved & (intruder > mine * OCCLUDER_NEARER)


def work_list(carried: DataFrame, frame: int, width: int, height: int) -> DataFrame:
    """px, py of the pixels to march: not carried, or dropped by this frame's turn of the dither."""
    spark = carried.sparkSession
    every = spark.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    due = (bayer_rank(F.col("px") % 8, F.col("py") % 8) + frame * DROPPED) % 64 < DROPPED
    kept = carried.where(~due).select("px", "py")
    return every.join(kept, ["px", "py"], "left_anti")


# --- residency -------------------------------------------------------------


def texture_bytes(tiles: Column, tile_texels: int, levels: Column) -> Column:
    side = (tiles * tile_texels).cast("long")
    return side * side * TEXEL_BYTES * levels


def reach_texels(tiles: Column, tile_texels: int) -> Column:
    return (F.floor(tiles / 2) - 1) * tile_texels


def levels_needed(raster: Column, reach: Column, available: Column) -> Column:
    """Levels until one reach covers the raster, at least one and at most those there are."""
    need = F.ceil(F.log2(raster / F.greatest(reach, F.lit(1)))).cast("int")
    return F.least(F.greatest(need, F.lit(0)) + 1, F.greatest(available, F.lit(1)))


def fitting_tiles(tiles: Column, tile_texels: int, raster: Column, available: Column, budget: int) -> Column:
    """Tiles a side, halved until the textures fit the budget, at least one."""
    out = F.lit(1)
    start = F.least(F.greatest(tiles, F.lit(1)), F.lit(MAX_TILES_ACROSS))
    for k in range(MAX_TILES_ACROSS.bit_length() - 1, -1, -1):
        n = F.floor(start / (1 << k))
        fits = texture_bytes(n, tile_texels, levels_needed(raster, reach_texels(n, tile_texels), available)) <= budget
        out = F.when((n >= 1) & fits, F.greatest(n, out)).otherwise(out)
    return out.cast("int")


def ceiling_half(v: Column) -> Column:
    """The smallest half-precision number that is not below v; minus infinity where rounding to nearest gives it."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
    up = F.when(v == 0, F.lit(0.0)).otherwise(F.ceil(v / step) * step)
    return F.when(v <= -65520, F.lit(float("-inf"))).when(up > 65504, F.lit(float("inf"))).otherwise(up)


def resident(t: Column, centre: Column, tiles: int) -> Column:
    """Whether a tile is in the half-open square of ``tiles`` a side around a centre."""
    return (t >= centre - tiles // 2) & (t < centre + tiles // 2)


def slot(t: Column, tiles: int) -> Column:
    """The slot that a tile has in a ring of ``tiles``."""
    return F.pmod(t, F.lit(tiles))
