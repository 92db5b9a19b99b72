"""Named regions of polygons with holes: which contain a point or a box, and the deepest that does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import hops
from .vector import at_spots, spots_in_rings

# Points a side that a box is probed with, and parents that are followed.
SAMPLES, MOST_DEPTH = 5, 100


def containing(points: DataFrame, rings: DataFrame, edges: DataFrame, cell: float, keys: tuple[str, ...]) -> DataFrame:
    """keys and region of points inside any polygon's exterior and none of its holes.

    ``rings``: ring, region, part, hole.  ``edges`` as of ``ring_edges``.
    """
    at, spots = at_spots(points, keys)
    return _spots(spots, rings, edges, cell).join(at.distinct(), ["px", "py"]).select(*keys, "region")


def _spots(spots: DataFrame, rings: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """px, py, region of different points inside; dealt by region once, where all that is known of it is counted."""
    named = edges.join(rings.select("ring", "region", "part", "hole"), "ring")
    inside = spots_in_rings(spots, named, cell, also=("region", "part", "hole"), by=("region",))
    parts = inside.groupBy("px", "py", "region", "part").agg(F.bool_or(~F.col("hole")).alias("out"), F.bool_or("hole").alias("in"))
    return parts.where("out and not in").select("px", "py", "region").distinct()


def probes(boxes: DataFrame, key: str = "box") -> DataFrame:
    """key, i, px, py: 5 x 5 points of each box (west, south, east, north), edges included."""
    at = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES * SAMPLES - 1))).alias("i")
    wide = boxes.select("*", at)
    across = lambda low, high, k: F.col(low) + (F.col(high) - F.col(low)) * k / (SAMPLES - 1)
    return wide.select(key, "i", across("west", "east", F.col("i") % SAMPLES).alias("px"), across("south", "north", F.floor(F.col("i") / SAMPLES)).alias("py"))


def containing_boxes(boxes: DataFrame, rings: DataFrame, edges: DataFrame, cell: float, key: str = "box") -> DataFrame:
    """key and region of boxes all of whose probes are inside."""
    at, spots = at_spots(probes(boxes, key), (key, "i"))
    hit = _spots(spots, rings, edges, cell).join(at.distinct(), ["px", "py"])
    return hit.groupBy(key, "region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == SAMPLES * SAMPLES).drop("n")


def deepest(boxes: DataFrame, rings: DataFrame, corners: DataFrame, edges: DataFrame, tree: DataFrame, cell: float, key: str = "box") -> DataFrame:
    """key, region: of the regions that hold a box the one that is ``chosen``; boxes that coincide are tested once."""
    sides = ["west", "south", "east", "north"]
    own = boxes.groupBy(*sides).agg(F.min(key).alias("first"))
    best = chosen(containing_boxes(own, rings, edges, cell, "first"), depths(tree), footprints(rings, corners), "first")
    same = boxes.select(key, *sides).join(own.join(best, "first").select(*sides, "region"), sides)
    return same.select(key, "region").distinct()


def footprints(rings: DataFrame, points: DataFrame) -> DataFrame:
    """region, footprint: the area of the box around a region's exteriors."""
    out = points.join(rings.where("not hole").select("ring", "region"), "ring").groupBy("region")
    return out.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("footprint"))


def depths(regions: DataFrame) -> DataFrame:
    """region, depth: parents above each region (region, parent), by doubling pointers; a parent that is no region counts as none, a loop as ``MOST_DEPTH``."""
    known = regions.select(F.col("region").alias("parent"), F.lit(True).alias("there"))
    links = regions.join(known, "parent", "left").select(F.col("region").alias("key"), F.when(F.col("there"), F.col("parent")).alias("prev"))
    out = hops(links)
    return out.select(F.col("key").alias("region"), F.when(F.col("up").isNull(), F.least("hops", F.lit(MOST_DEPTH))).otherwise(MOST_DEPTH).cast("int").alias("depth"))


def chosen(hits: DataFrame, levels: DataFrame, sizes: DataFrame, key: str = "box") -> DataFrame:
    """key, region: of the regions that contain a box the deepest, then that of the least footprint, then of the least name."""
    ranked = hits.join(levels, "region").join(sizes, "region").groupBy(key).agg(F.min(F.struct((-F.col("depth")).alias("d"), "footprint", "region")).alias("b"))
    return ranked.select(key, "b.region")
