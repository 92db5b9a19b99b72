"""Files as rows: listings, what a copy lacks, digests, products with a manifest, and images written as PNG."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MANIFEST


def _files(spark: SparkSession, root: str, pattern: str, *more: Column) -> DataFrame:
    """path (below ``root``), length and whatever else; the reader leaves out files without a byte, so names come from its index."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    names = spark.createDataFrame([(n,) for n in read.inputFiles()], "path string")
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z]+:/*", "/")
    stem = "/" + root.split(":", 1)[-1].strip("/") + "/"
    every = names.select(plain(F.url_decode(F.regexp_replace("path", r"\+", "%2B"))).alias("path"))
    found = every.join(read.select(plain(F.col("path")).alias("path"), "length", *more), "path", "left")
    below = F.when(F.startswith(F.col("path"), F.lit(stem)), F.substring(F.col("path"), len(stem) + 1, 1 << 20)).otherwise(F.col("path"))
    return found.withColumn("path", below).withColumn("length", F.coalesce("length", F.lit(0)))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below ``root``), length, modified (null for an empty file) of every file in all folders; contents are not read."""
    return _files(spark, root, pattern, F.col("modificationTime").alias("modified"))


def lacking(here: DataFrame, there: DataFrame) -> DataFrame:
    """Files of one listing that the other does not have in the same length."""
    return here.join(there.select("path", "length"), ["path", "length"], "left_anti")


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, md5 of whole files (a file must fit a binary value, 2 GB)."""
    found = _files(spark, root, pattern, F.md5("content").alias("md5"))
    return found.withColumn("md5", F.coalesce("md5", F.md5(F.lit(b""))))


def published_md5(text: Column) -> Column:
    """The digest of a checksum file (32 hex digits, then blanks and a name); null if there is none."""
    found = F.regexp_extract(text, r"^\s*([0-9A-Fa-f]{32})(?:\s|$)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def discover(spark: SparkSession, root: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Manifests of the products under a folder, by name; all of them unless some are named."""
    found = spark.read.schema(MANIFEST).json(f"{root}/*/manifest")
    return (found.where(F.col("product").isin(*wanted)) if wanted else found).orderBy("product")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """Eight-bit RGBA rows from the top as a PNG, marked as encoded in sRGB."""
    if len(rgba) != width * height * 4:
        raise ValueError(f"{len(rgba)} bytes for {width} x {height} pixels")
    rows = b"".join(b"\0" + rgba[k : k + width * 4] for k in range(0, len(rgba), width * 4))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"sRGB", b"\0") + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def png_tiles(pixels: DataFrame, side: int = 512) -> DataFrame:
    """Pixels (x, y, r, g, b, a) as images of ``side`` pixels: tx, ty, content.

    Pixels that are not there stay transparent black, as do nulls; of repeated
    ones the greatest counts.  No group holds more than a tile.
    """

    def encode(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        raw = bytearray(side * side * 4)
        for at, *colour in g[["at", "r", "g", "b", "a"]].itertuples(index=False, name=None):
            raw[at * 4 : at * 4 + 4] = bytes(colour)
        return pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "content": [png(side, side, bytes(raw))]})

    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    at = (F.pmod(F.col("y"), F.lit(side)) * side + F.pmod(F.col("x"), F.lit(side))).cast("int").alias("at")
    byte = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in "rgba"]
    one = pixels.dropna(subset=["x", "y"]).select(tile("x").alias("tx"), tile("y").alias("ty"), at, F.struct(*byte).alias("c")).groupBy("tx", "ty", "at").agg(F.max("c").alias("c"))
    return one.select("tx", "ty", "at", "c.*").groupBy("tx", "ty").applyInPandas(encode, "tx long, ty long, content binary")
