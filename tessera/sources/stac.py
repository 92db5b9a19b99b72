"""Catalogue answers as rows: items with assets, and regions with polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ITEMS = "struct<features: array<struct<id: string, bbox: array<double>, properties: map<string, string>, assets: map<string, struct<href: string>>>>, links: array<struct<rel: string, href: string>>>"
_REGIONS = "struct<features: array<struct<properties: struct<id: string, name: string, urls: map<string, string>>, geometry: struct<type: string, coordinates: string>>>>"
_POLYGON, _MANY = "array<array<array<double>>>", "array<array<array<array<double>>>>"
#: Pages of an answer that are followed, at most; more is an error, not a shorter answer.
MOST_PAGES = 32


def items(pages: DataFrame, asset: str, epsg: int, box: tuple[float, float, float, float], body: str = "body") -> DataFrame:
    """id, href, west, south, east, north of items that overlap a box (west, south, east, north) and have the asset.

    Items without the asset are skipped; an item in another reference system
    fails the query, since its metres would not fit.  Null bodies give no rows.
    """
    one = pages.select(F.inline(F.from_json(body, _ITEMS)["features"]))
    code = F.coalesce(F.try_element_at("properties", F.lit("proj:epsg")), F.regexp_extract(F.try_element_at("properties", F.lit("proj:code")), r"(\d+)$", 1))
    href = F.try_element_at("assets", F.lit(asset))["href"]
    ok = F.when(code == str(epsg), href).otherwise(F.raise_error(F.concat(F.lit("item "), F.col("id"), F.lit(f" is not in EPSG {epsg}"))))
    corner = lambda k, n: F.col("bbox")[k].alias(n)
    out = one.where(href.isNotNull()).select("id", ok.alias("href"), corner(0, "west"), corner(1, "south"), corner(2, "east"), corner(3, "north"))
    return out.where((F.col("west") <= box[2]) & (F.col("east") >= box[0]) & (F.col("south") <= box[3]) & (F.col("north") >= box[1]))


def next_page(pages: DataFrame, body: str = "body") -> DataFrame:
    """href of the page that follows each, where one does."""
    return pages.select(F.inline(F.from_json(body, _ITEMS)["links"])).where("rel = 'next'").select("href")


def regions(index: DataFrame, body: str = "body") -> DataFrame:
    """region, name, url, part, ring, hole, pos, x, y of Polygon and MultiPolygon regions; other shapes and regions without a ``pbf`` url are skipped."""
    one = index.select(F.inline(F.from_json(body, _REGIONS)["features"]))
    url, shape = F.try_element_at("properties.urls", F.lit("pbf")), F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(shape, _POLYGON))).when(F.col("geometry.type") == "MultiPolygon", F.from_json(shape, _MANY))
    flat = one.where(url.isNotNull()).select(F.col("properties.id").alias("region"), F.col("properties.name").alias("name"), url.alias("url"), F.posexplode(parts).alias("part", "rings"))
    rings = flat.select("region", "name", "url", "part", F.posexplode("rings").alias("k", "points"))
    at = rings.select("region", "name", "url", "part", F.concat_ws("/", "region", "part", "k").alias("ring"), (F.col("k") > 0).alias("hole"), F.posexplode("points").alias("pos", "p"))
    return at.select("region", "name", "url", "part", "ring", "hole", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
