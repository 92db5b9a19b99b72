"""Projections in closed form: Lambert conformal conic (two parallels), Mercator, and boxes under them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS 80; parallels 49N and 77N, false origin 49N 95W (EPSG 3979); the sphere of EPSG 3857; WGS 84.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101
PARALLELS, ORIGIN = (49.0, 77.0), (49.0, -95.0)
WGS84_INVERSE_FLATTENING = 298.257223563

_F = 1 / INVERSE_FLATTENING
_E = math.sqrt(_F * (2 - _F))


def _scale(lat: float) -> float:
    s = math.sin(lat)
    return math.cos(lat) / math.sqrt(1 - (_E * s) ** 2)


def _isometric(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_P1, _P2 = map(math.radians, PARALLELS)
_N = (math.log(_scale(_P1)) - math.log(_scale(_P2))) / (math.log(_isometric(_P1)) - math.log(_isometric(_P2)))
_C = _scale(_P1) / (_N * _isometric(_P1) ** _N)
_R0 = A * _C * _isometric(math.radians(ORIGIN[0])) ** _N


def lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees -> metres of EPSG 3979."""
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    r = A * _C * F.pow(t, F.lit(_N))
    theta = _N * F.radians(lon - ORIGIN[1])
    return r * F.sin(theta), _R0 - r * F.cos(theta)


def lambert_inverse(x: Column, y: Column, rounds: int = 7) -> tuple[Column, Column]:
    """Metres of EPSG 3979 -> degrees; the latitude by a fixed number of substitutions."""
    r = F.sqrt(x * x + (_R0 - y) * (_R0 - y))
    t = F.pow(r / (A * _C), F.lit(1 / _N))
    step = lambda phi: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - F.sin(phi) * _E) / (1 + F.sin(phi) * _E), F.lit(_E / 2)))
    first = F.lit(math.pi / 2) - 2 * F.atan(t)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda acc, _: step(acc))
    return F.degrees(F.atan2(x, _R0 - y) / _N) + ORIGIN[1], F.degrees(phi)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees -> metres of EPSG 3857."""
    return A * F.radians(lon), A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """East-west and north-south metres of a degree on WGS 84."""
    e2 = (2 - 1 / WGS84_INVERSE_FLATTENING) / WGS84_INVERSE_FLATTENING
    s = F.sin(F.radians(lat))
    w = 1 - e2 * s * s
    return F.radians(A / F.sqrt(w) * F.cos(F.radians(lat))), F.radians(A * (1 - e2) / (w * F.sqrt(w)))


def boundary_box(boxes: DataFrame, project, steps: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bounds of boxes (x0, y0, x1, y1) after ``project``, by walking their edges in ``steps`` steps."""
    t = F.col("k") / F.lit(float(steps))
    walk = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * t
    edges = F.array(*(F.struct(x.alias("px"), y.alias("py")) for x, y in ((at("x0", "x1"), F.col("y0")), (at("x0", "x1"), F.col("y1")), (F.col("x0"), at("y0", "y1")), (F.col("x1"), at("y0", "y1")))))
    x, y = project(F.col("px"), F.col("py"))
    points = walk.select(*keys, F.inline(edges)).select(*keys, x.alias("x"), y.alias("y"))
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
