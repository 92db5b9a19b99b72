"""Pyramid roll-ups over cell tables (keys..., x, y, value).

Every fold is a hash aggregate on the halved key, so that partial sums are
combined before the shuffle.  A missing row is nodata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import linear_to_srgb, srgb_to_linear


def halved(steps: int = 1) -> list[Column]:
    return [F.shiftright("x", steps).alias("x"), F.shiftright("y", steps).alias("y")]


def mean_parts(cells: DataFrame, value: str = "h", steps: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum and count of the cells under each coarser one; they roll up further exactly."""
    return cells.groupBy(*by, *halved(steps)).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def mean_f32(cells: DataFrame, value: str = "h") -> DataFrame:
    """Mean of up to four children, summed in single precision in reading order."""
    slot = F.col("x").bitwiseAND(1) + F.col("y").bitwiseAND(1) * 2
    kids = cells.groupBy(*halved()).agg(*(F.max(F.when(slot == k, F.col(value).cast("float"))).alias(f"c{k}") for k in range(4)))
    zero, one = F.lit(0).cast("float"), F.lit(1).cast("float")
    total, n = zero, zero
    for k in range(4):
        total = (total + F.coalesce(F.col(f"c{k}"), zero)).cast("float")
        n = (n + F.when(F.col(f"c{k}").isNotNull(), one).otherwise(zero)).cast("float")
    return kids.select("x", "y", (total / n).cast("float").alias(value))


def mean_chain(cells: DataFrame, levels: int, value: str = "h") -> DataFrame:
    """level, x, y, value: each level the single-precision mean of the one below.

    A level's shuffle is the input of the next and of its own rows; the branches
    of the union share it, so no level is computed twice.
    """
    now = cells.select("x", "y", F.col(value).cast("float").alias(value))
    out = now.select(F.lit(0).alias("level"), "x", "y", value)
    for k in range(1, levels + 1):
        now = mean_f32(now, value)
        out = out.unionByName(now.select(F.lit(k).alias("level"), "x", "y", value))
    return out


def mean_colour(cells: DataFrame) -> DataFrame:
    """Mean in linear light of r, g, b bytes; black is nodata."""
    lit = cells.where("r <> 0 or g <> 0 or b <> 0")
    return lit.groupBy(*halved()).agg(*(linear_to_srgb(F.avg(srgb_to_linear(F.col(c)))).alias(c) for c in "rgb"))


def mode(cells: DataFrame, ident: str = "id", precedence: str | None = None, steps: int = 1) -> DataFrame:
    """Commonest id under each coarser cell, 0 left out.  Ties: higher precedence if given, then lower id."""
    keys = [ident] + ([precedence] if precedence else [])
    count = cells.where(F.col(ident) != 0).groupBy(*halved(steps), *keys).agg(F.count(F.lit(1)).alias("n"))
    rank = [F.col("n")] + ([F.col(precedence)] if precedence else []) + [-F.col(ident)]
    best = F.max_by(F.struct(ident, "n"), F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank))))
    return count.groupBy("x", "y").agg(best.alias("b")).select("x", "y", F.col(f"b.{ident}").alias(ident), "b.n")


def quad_max(cells: DataFrame, value: str = "h", by: tuple[str, ...] = ()) -> DataFrame:
    """Maximum over the closed square (x, y) to (x+1, y+1): each sample bounds four cells."""
    corners = F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for dx in (0, 1) for dy in (0, 1)))
    return cells.select(*by, value, F.explode(corners).alias("c")).groupBy(*by, "c.x", "c.y").agg(F.max(value).alias(value))


def reduce_max(cells: DataFrame, value: str = "h", by: tuple[str, ...] = ()) -> DataFrame:
    return cells.groupBy(*by, *halved()).agg(F.max(value).alias(value))


def max_pyramid(levels: list[DataFrame], value: str = "h") -> DataFrame:
    """depth, x, y and the bound of every cell: M0 = quad_max(L0), Md = max(reduce_max(Md-1), quad_max(Ld)).

    A level's closed squares reach one sample over the edge of its own cells, so
    a coarse cell can carry a bound where no finer cell does.
    """
    out, below = [], None
    for depth, level in enumerate(levels):
        own = quad_max(level, value).select("x", "y", value)
        below = own if below is None else reduce_max(below, value).unionByName(own).groupBy("x", "y").agg(F.max(value).alias(value))
        out.append(below.withColumn("depth", F.lit(depth)))
    found = out[0]
    for level in out[1:]:
        found = found.unionByName(level)
    return found


#: Folds by name, for pyramids whose fold is a parameter.
FOLDS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def build_levels(cells: DataFrame, count: int, fold: str = "max", value: str = "h") -> DataFrame:
    """level, x, y, value of ``count`` levels, each from the base at once: right for folds that compose (all but mean)."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("level")
    wide = cells.select(levels, "x", "y", value)
    return wide.groupBy("level", F.expr("shiftright(x, level)").alias("x"), F.expr("shiftright(y, level)").alias("y")).agg(FOLDS[fold](value).alias(value))


def value_range(cells: DataFrame, value: str = "h") -> DataFrame:
    """Least and greatest value; 0 and 0 where there is none."""
    return cells.agg(F.coalesce(F.min(value), F.lit(0)).alias("low"), F.coalesce(F.max(value), F.lit(0)).alias("high"))


def histogram(cells: DataFrame, ident: str = "id", top: int | None = None) -> DataFrame:
    """id, n, share of all cells; by n, then id.  ``top`` rows if given."""
    total = F.sum("n").over(Window.partitionBy())
    out = cells.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total).orderBy(F.desc("n"), ident)
    return out.limit(top) if top else out
