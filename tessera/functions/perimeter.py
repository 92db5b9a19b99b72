"""A rectangle's border as a line: clockwise from the north-west corner, so that what a cycle encloses is on its right."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres within which a point counts as on the border, and from which a loose end is pulled to it.
EDGE_EPSILON = 0.01
DANGLE_METRES = 25_000.0


@dataclass(frozen=True)
class Rect:
    west: float
    south: float
    east: float
    north: float

    @property
    def width(self) -> float:
        return self.east - self.west

    @property
    def height(self) -> float:
        return self.north - self.south

    @property
    def around(self) -> float:
        return 2 * (self.width + self.height)

    def contains(self, x: Column, y: Column) -> Column:
        """Closed on all sides."""
        return x.between(self.west, self.east) & y.between(self.south, self.north)

    def _off(self, x: Column, y: Column) -> dict[str, Column]:
        return {"n": F.abs(self.north - y), "e": F.abs(self.east - x), "s": F.abs(y - self.south), "w": F.abs(x - self.west)}

    def on_border(self, x: Column, y: Column) -> Column:
        return self.contains(x, y) & (F.least(*self._off(x, y).values()) < EDGE_EPSILON)

    def along(self, x: Column, y: Column) -> Column:
        """Metres along the border; meaningful for points on it.  At a corner the earlier side in the order north, east, south, west decides."""
        off = self._off(x, y)
        east, south, west = self.width, self.width + self.height, 2 * self.width + self.height
        out = F.when(off["n"] < EDGE_EPSILON, x - self.west).when(off["e"] < EDGE_EPSILON, east + (self.north - y))
        return out.when(off["s"] < EDGE_EPSILON, south + (self.east - x)).otherwise(west + (y - self.south))

    def corners_between(self, start: Column, stop: Column) -> Column:
        """Corners passed from one place on the border to another, in the order of passing: array of (ahead, x, y)."""
        ahead = lambda t: F.when(t > start, t - start).otherwise(t - start + self.around)
        places = [(self.width, self.east, self.north), (self.width + self.height, self.east, self.south), (2 * self.width + self.height, self.west, self.south), (self.around, self.west, self.north)]
        corners = F.array(*(F.struct(ahead(F.lit(t)).alias("ahead"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in places))
        return F.array_sort(F.filter(corners, lambda c: c["ahead"] < ahead(stop)))

    def nearest(self, x: Column, y: Column, within: float = DANGLE_METRES) -> Column:
        """The border point nearest to a point inside, struct(x, y); null beyond ``within``.  Ties: west, east, south, north."""
        options = [(x - self.west, F.lit(self.west), y), (self.east - x, F.lit(self.east), y), (y - self.south, x, F.lit(self.south)), (self.north - y, x, F.lit(self.north))]
        least = F.least(*(o[0] for o in options))
        point = lambda o: F.struct(o[1].cast("double").alias("x"), o[2].cast("double").alias("y"))
        out = F.when(options[0][0] == least, point(options[0]))
        for o in options[1:]:
            out = out.when(o[0] == least, point(o))
        return F.when(least <= within, out)
