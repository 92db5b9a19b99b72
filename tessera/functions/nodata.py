"""When a texel, a tile or a failure counts as nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinel that heights are written with, the bound that they are read by, and byte counts of empty tiles by product.
HEIGHT_NODATA = -32767.0
HEIGHT_BELOW = -30000.0
EMPTY_BYTES = {"hrdem": 7988, "mrdem": 3994, "imagery": 0}


def no_height(h: Column) -> Column:
    """Below the bound; null too."""
    return F.coalesce(h < HEIGHT_BELOW, F.lit(True))


def no_colour(r: Column, g: Column, b: Column) -> Column:
    return (r == 0) & (g == 0) & (b == 0)


def no_material(ident: Column) -> Column:
    return F.coalesce(ident == 0, F.lit(True))


def empty_tile(n_bytes: Column, limit: Column | int) -> Column:
    """Tiles without a byte count, without bytes, or of at most ``limit`` bytes."""
    return F.coalesce((n_bytes == 0) | (n_bytes <= limit), F.lit(True))


def transient(status: Column) -> Column:
    """Failures worth another try: no answer at all, too many requests, or the server's own."""
    return F.coalesce((status == 429) | status.between(500, 599), F.lit(True))
