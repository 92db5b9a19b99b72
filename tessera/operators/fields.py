"""Coarse channels sampled between their cells, with the slope and the fall of the land; holes filled from a raster of another projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fill import _catmull_rom, bilinear


def sample(points: DataFrame, cells: DataFrame, keys: tuple[str, ...], size: tuple[int, int], metres: float, channels: tuple[str, ...], height: str = "h") -> DataFrame:
    """Smooth samples of each channel at the points (x, y in raster metres), slope and (east, south), the unit vector downhill.

    The 32 cells that any of the five height samples at a place needs are
    gathered once for each place of the raster; a point meets its place in one
    row, with the weights that the cells have in the height and in the two
    central differences.  Reads beyond the raster are clamped.  Flat ground has
    no direction (0, 0).  A point with a cell missing is left out, as are points
    with a null coordinate; an empty table gives no rows.
    """
    zero = F.lit(0.0)
    px, py = F.col("x") / metres, F.col("y") / metres
    # Weights of the cells -3 .. 4 around a point; beyond a few cells outside, all places read the same cells.
    ahead = [F.array(zero, zero, *_catmull_rom(F.col(f"__p{c}") - F.col(f"__{c}0")), zero, zero).alias(f"__w{c}") for c in "xy"]
    place = [F.least(F.greatest(F.col(f"__{c}0"), F.lit(-3)), F.lit(n + 1)).cast("long").alias(f"__k{c}") for c, n in zip("xy", size, strict=True)]
    at = points.where("x is not null and y is not null").select(*keys, px.alias("__px"), py.alias("__py"), F.floor(px).alias("__x0"), F.floor(py).alias("__y0")).select(*keys, *place, *ahead)
    met = at.join(_around(cells.select("x", "y", *channels).dropna(), size, channels), ["__kx", "__ky"])
    weight = lambda c, k: F.get(f"__w{c}", k)
    apart = lambda c, k: F.get(f"__w{c}", k + 1) - F.get(f"__w{c}", k - 1)  # noqa: E731  (sample a cell before) - (sample a cell after)
    total = lambda f: F.aggregate("__cells", zero, lambda sum_, cell: sum_ + f(cell))
    value = lambda c: total(lambda t: weight("x", t["i"]) * weight("y", t["j"]) * t[c].cast("double"))
    fall_e = total(lambda t: apart("x", t["i"]) * weight("y", t["j"]) * t[height].cast("double")) / (2 * metres)
    fall_s = total(lambda t: weight("x", t["i"]) * apart("y", t["j"]) * t[height].cast("double")) / (2 * metres)
    out = met.select(*keys, *(value(c).alias(c) for c in channels), fall_e.alias("we"), fall_s.alias("ws"))
    slope = F.sqrt(F.col("we") * F.col("we") + F.col("ws") * F.col("ws"))
    way = lambda w: F.when(F.col("slope") > 1e-6, F.col(w) / F.nullif(F.col("slope"), zero)).otherwise(zero)
    return out.withColumn("slope", slope).select(*keys, *channels, "slope", way("we").alias("east"), way("ws").alias("south"))


#: Offsets (3 more than the column, 3 more than the row) of the cells that samples at a place and a cell beside it need.
_PAIRS = [(i, j) for i in range(1, 7) for j in range(1, 7) if 2 <= i <= 5 or 2 <= j <= 5]


def _around(cells: DataFrame, size: tuple[int, int], channels: tuple[str, ...]) -> DataFrame:
    """__kx, __ky, __cells: the cells (i, j, channels) around every place of the raster that has all of them, places outside it included."""
    spark = cells.sparkSession

    def reach(c: str, n: int, k: str) -> DataFrame:
        at = spark.range(-3, n + 2).select(F.col("id").alias(f"__k{c}"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias(k))
        return at.select(f"__k{c}", k, F.least(F.greatest(F.col(f"__k{c}") + F.col(k) - 3, F.lit(0)), F.lit(n - 1)).alias(c))

    wide = cells.join(reach("x", size[0], "i"), "x").join(reach("y", size[1], "j"), "y").where("i between 2 and 5 or j between 2 and 5")
    near = wide.groupBy("__kx", "__ky").agg(F.collect_list(F.struct("i", "j", *channels)).alias("__cells"))
    return near.where(F.size("__cells") == len(_PAIRS)).withColumn("__cells", F.sort_array("__cells"))


@dataclass(frozen=True)
class Lattice:
    """Where texels lie: the outer corner of texel (0, 0) and the side of a texel; north is up."""

    west: float
    north: float
    metres: float

    def centre(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.west + (x + 0.5) * self.metres, self.north - (y + 0.5) * self.metres

    def texel(self, e: Column, n: Column) -> tuple[Column, Column]:
        """Whole at the centres of texels."""
        return (e - self.west) / self.metres - 0.5, (self.north - n) / self.metres - 0.5


def fill_from(holes: DataFrame, target: Lattice, source: DataFrame, at: Lattice, project: Callable | None = None, value: str = "h") -> DataFrame:
    """The holes (x, y) that a source raster can supply, bilinearly: their centres are projected and read between its texels.

    A hole with a corner missing or outside the source stays one and has no row;
    several sources are asked in turn, each for what the one before left.
    ``project`` takes the target's coordinates to the source's; None if they
    share them.
    """
    e, n = target.centre(F.col("x"), F.col("y"))
    e, n = project(e, n) if project else (e, n)
    px, py = at.texel(F.col("__e"), F.col("__n"))
    p = holes.select("x", "y", e.alias("__e"), n.alias("__n")).select(F.col("x").alias("tx"), F.col("y").alias("ty"), px.alias("px"), py.alias("py"))
    return bilinear(p, source.dropna(subset=[value]), "px", "py", ("tx", "ty"), value).select(F.col("tx").alias("x"), F.col("ty").alias("y"), value)


def fill_in_turn(wanted: DataFrame, target: Lattice, sources: list[tuple[DataFrame, Lattice, Callable | None]], value: str = "h") -> DataFrame:
    """Cells (x, y, value, tier): each from the first source, counted from 1, that reaches it."""
    found = [fill_from(wanted, target, s, at, project, value).withColumn("tier", F.lit(k)) for k, (s, at, project) in enumerate(sources, 1)]
    best = F.min(F.struct("tier", value))
    return reduce(DataFrame.unionByName, found).groupBy("x", "y").agg(best.alias("b")).select("x", "y", f"b.{value}", "b.tier")
