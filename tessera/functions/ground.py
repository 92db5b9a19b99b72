"""Kinds of ground from a landscape's channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Slopes, depths and flows between which a kind of ground sets in.
GENTLE_SLOPE, STEEP_SLOPE = 0.25, 0.90
SHORE_METRES, LAKE_METRES = 0.4, 2.5
CHANNEL_FLOW, RIVER_FLOW = 11.5, 15.5
FILLED_METRES = 6.0
CHANNEL_WIDTH_CELLS = 2.5


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def water_depth(filled: Column, height: Column) -> Column:
    return F.greatest(filled - height, F.lit(0.0))


def fractions(slope: Column, depth: Column, flow: Column, hardness: Column, deposit: Column, texel: float, cell: float) -> dict[str, Column]:
    """steepness, rockiness, filling, lake and channel, each from 0 to 1."""
    steep, lake = smoothstep(GENTLE_SLOPE, STEEP_SLOPE, slope), smoothstep(SHORE_METRES, LAKE_METRES, depth)
    seen = smoothstep(0.5, 1.5, F.lit(CHANNEL_WIDTH_CELLS * cell / (2 * texel)))
    return {
        "steepness": steep, "rockiness": steep * (0.35 + 0.65 * hardness), "filling": smoothstep(0.0, FILLED_METRES, deposit), "lake": lake,
        "channel": smoothstep(CHANNEL_FLOW, RIVER_FLOW, flow) * (1 - lake) * seen,
    }


def flooded_share(cells: DataFrame, filled: str = "filled", height: str = "h") -> DataFrame:
    """share: of the cells, those under more water than a lake's depth; null without cells."""
    return cells.agg(F.avg((F.col(filled) - F.col(height) > LAKE_METRES).cast("double")).alias("share"))


def rescale(cells: DataFrame, low: float, high: float, value: str = "h") -> DataFrame:
    """Heights stretched to a range; cells as they are if they span less than a thousandth.  The range is one row, so its table is broadcast."""
    span = cells.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    flat = F.col("__high") - F.col("__low") < 1e-3
    to = low + (F.col(value) - F.col("__low")) * ((high - low) / (F.col("__high") - F.col("__low")))
    out = cells.join(F.broadcast(span)).withColumn(value, F.when(flat, F.col(value).cast("double")).otherwise(to))
    return out.drop("__low", "__high")
