"""Tiered gap filling with provenance, resampling and window reads over cell tables (x, y, h)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier_fill(tiers: list[DataFrame], value: str = "h") -> DataFrame:
    """x, y, value, tier (1, 2, ...): each cell from the first tier that has it, never blended.

    One aggregate over the union of the tiers instead of a join for each: a
    cell's best is the row with the smallest tier number.
    """
    marked = [t.select("x", "y", value, F.lit(k).alias("tier")) for k, t in enumerate(tiers, 1)]
    every = reduce(DataFrame.unionByName, marked)
    return every.groupBy("x", "y").agg(F.min_by(value, "tier").alias(value), F.min("tier").alias("tier"))


def first_wins(cells: DataFrame, order: str, value: str = "h") -> DataFrame:
    return cells.groupBy("x", "y").agg(F.min_by(value, order).alias(value))


def last_wins(cells: DataFrame, order: str, value: str = "h") -> DataFrame:
    return cells.groupBy("x", "y").agg(F.max_by(value, order).alias(value))


def provenance_tally(filled: DataFrame, tiers: int, cells: int) -> DataFrame:
    """Cells by tier, missing ones of ``cells``, and shares in percent."""
    counts = [F.count_if(F.col("tier") == k).alias(f"tier_{k}") for k in range(1, tiers + 1)]
    t = filled.agg(*counts).withColumn("missing", F.lit(cells) - sum(F.col(f"tier_{k}") for k in range(1, tiers + 1)))
    share = lambda c: F.round(F.col(c) * 100.0 / cells, 6).alias(f"{c}_percent")
    return t.select("*", *(share(f"tier_{k}") for k in range(1, tiers + 1)), share("missing"))


def coverage_estimate(filled: DataFrame, stride: int, width: int, height: int, tiers: int) -> DataFrame:
    """The tally over a strided sample of the grid; ``unsurveyed`` is what the first tier lacks, 1 for an empty sample."""
    sampled = ((width + stride - 1) // stride) * ((height + stride - 1) // stride)
    hit = filled.where(f"x % {stride} = 0 and y % {stride} = 0 and x between 0 and {width - 1} and y between 0 and {height - 1}")
    t = hit.agg(*(F.count_if(F.col("tier") == k).alias(f"tier_{k}") for k in range(1, tiers + 1)))
    rest = F.lit(sampled) - sum(F.col(f"tier_{k}") for k in range(1, tiers + 1))
    unsurveyed = F.lit(1.0) if not sampled else F.round(1 - F.col("tier_1") / sampled, 6)
    return t.select(F.lit(sampled).cast("long").alias("sampled"), "*", rest.alias("missing"), unsurveyed.alias("unsurveyed"))


def grid(spark, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Every cell of a window."""
    n = x1 - x0
    return spark.range(n * (y1 - y0)).select((F.col("id") % n + x0).alias("x"), (F.floor(F.col("id") / n) + y0).alias("y"))


def hole_extent(cells: DataFrame, x0: int, y0: int, x1: int, y1: int, margin: int = 0) -> DataFrame:
    """Bounds (with a margin, cut to the window) and number of the window's cells without a row."""
    holes = grid(cells.sparkSession, x0, y0, x1, y1).join(cells.select("x", "y"), ["x", "y"], "left_anti")
    return holes.agg(
        F.greatest(F.min("x") - margin, F.lit(x0)).alias("x0"), F.greatest(F.min("y") - margin, F.lit(y0)).alias("y0"),
        F.least(F.max("x") + margin, F.lit(x1 - 1)).alias("x1"), F.least(F.max("y") + margin, F.lit(y1 - 1)).alias("y1"), F.count(F.lit(1)).alias("holes"),
    )


def weighted_sample(points: DataFrame, cells: DataFrame, taps: Column, need: int, keys: tuple[str, ...], value: str = "h") -> DataFrame:
    """Sum of weight * value over the taps (array of struct x, y, w) of each point that finds ``need`` cells."""
    wide = points.select(*keys, F.inline(taps))
    return wide.join(cells.select("x", "y", value), ["x", "y"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col(value)).alias(value), F.count(value).alias("n")).where(F.col("n") == need).drop("n")


def bilinear(points: DataFrame, cells: DataFrame, px: str, py: str, keys: tuple[str, ...], value: str = "h") -> DataFrame:
    """Bilinear sample at texel coordinates; a missing corner refuses the point."""
    x0, y0 = F.floor(px), F.floor(py)
    fx, fy = F.col(px) - x0, F.col(py) - y0
    taps = F.array(*(F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dx in (0, 1) for dy in (0, 1)))
    return weighted_sample(points, cells, taps, 4, keys, value)


def _catmull_rom(t: Column) -> list[Column]:
    a, b = t * t, t * t * t
    return [(-b + 2 * a - t) / 2, (3 * b - 5 * a + 2) / 2, (-3 * b + 4 * a + t) / 2, (b - a) / 2]


def catmull_rom(points: DataFrame, cells: DataFrame, px: str, py: str, keys: tuple[str, ...], width: int, height: int, value: str = "h") -> DataFrame:
    """Smooth sample from 4 x 4 taps, clamped to the raster."""
    x0, y0 = F.floor(px), F.floor(py)
    wx, wy = _catmull_rom(F.col(px) - x0), _catmull_rom(F.col(py) - y0)
    inside = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    taps = F.array(*(F.struct(inside(x0 + i - 1, width).alias("x"), inside(y0 + j - 1, height).alias("y"), (wx[i] * wy[j]).alias("w")) for i in range(4) for j in range(4)))
    return weighted_sample(points, cells, taps, 16, keys, value)


def window_read(cells: DataFrame, x0: int, y0: int, x1: int, y1: int, bounds: tuple[int, int, int, int] | None = None, value: str = "h") -> DataFrame:
    """Every cell of a window; ``bounds`` (inclusive) given, reads outside are clamped to the border, else they are null."""
    w = grid(cells.sparkSession, x0, y0, x1, y1)
    if bounds:
        inside = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
        w = w.withColumn("sx", inside("x", bounds[0], bounds[2])).withColumn("sy", inside("y", bounds[1], bounds[3]))
    else:
        w = w.withColumn("sx", F.col("x")).withColumn("sy", F.col("y"))
    return w.join(cells.select(F.col("x").alias("sx"), F.col("y").alias("sy"), value), ["sx", "sy"], "left").select("x", "y", value)
