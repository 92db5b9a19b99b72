"""Products as partitioned tables with a manifest that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE, VERSION = 512, 1
MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("product", T.StringType()), T.StructField("epsg", T.IntegerType()),
    T.StructField("tile_size", T.IntegerType()), T.StructField("base_level", T.IntegerType()), T.StructField("level_count", T.IntegerType()),
    T.StructField("base_metres_per_texel", T.DoubleType()), T.StructField("origin_metres", T.ArrayType(T.DoubleType())),
    T.StructField("extent_texels", T.ArrayType(T.LongType())), T.StructField("bands", T.IntegerType()), T.StructField("nodata", T.DoubleType()),
])


def check(m: dict) -> dict:
    """The manifest, or an error that names what is wrong with it."""
    top = 1 << (m["base_level"] + m["level_count"] - 1)
    rules = {
        "version": m["version"] == VERSION, "tile_size": m["tile_size"] == TILE, "level_count": m["level_count"] >= 1, "bands": m["bands"] >= 1,
        "base_metres_per_texel": 0 < m["base_metres_per_texel"] < float("inf"), "origin_metres": all(abs(v) < float("inf") for v in m["origin_metres"]),
        "extent_texels": all(v > 0 and v % top == 0 for v in m["extent_texels"]),
    }
    for name, ok in rules.items():
        if not ok:
            raise ValueError(f"manifest of {m['product']}: {name} is {m[name]}")
    return m


def covers_same_ground(a: dict, b: dict) -> bool:
    return all(a[k] == b[k] for k in ("epsg", "origin_metres", "extent_texels", "base_metres_per_texel"))


def write_product(cells: DataFrame, root: str, manifest: dict) -> None:
    """Cells (level, x, y, value) by level and tile, then the manifest; what has none is not there.

    On a rewrite the old manifest goes first, so that a run that is killed
    leaves no product rather than a mixed one.
    """
    check(manifest)
    _delete(cells.sparkSession, f"{root}/{manifest['product']}/manifest")
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    out = cells.withColumn("tx", tile("x")).withColumn("ty", tile("y"))
    out.repartition("level", "tx", "ty").sortWithinPartitions("ty", "tx", "y", "x").write.mode("overwrite").partitionBy("level").parquet(f"{root}/{manifest['product']}/cells")
    cells.sparkSession.createDataFrame([manifest], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/{manifest['product']}/manifest")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _delete(spark: SparkSession, at: str) -> None:
    path, files = _path(spark, at)
    files.delete(path, True)


def find_product(spark: SparkSession, root: str, product: str) -> DataFrame | None:
    """The product's cells, or None where no manifest is."""
    path, files = _path(spark, f"{root}/{product}/manifest")
    return read_product(spark, root, product) if files.exists(path) else None


def typed(product: DataFrame, value: str, kind: str) -> DataFrame:
    """The product, if its values are of a type (``float`` heights, ``int`` materials); else an error."""
    have = product.schema[value].dataType.simpleString()
    if have != kind:
        raise TypeError(f"{value} is {have}, not {kind}")
    return product


def dense_rect(product: DataFrame, level: int, x0: int, y0: int, width: int, height: int, nodata: float, value: str = "h") -> DataFrame:
    """x, y, value of every place of a rectangle; ``nodata`` where the product has no cell."""
    spark = product.sparkSession
    places = spark.range(width * height).select((F.col("id") % width + x0).alias("x"), (F.floor(F.col("id") / width) + y0).alias("y"))
    have = read_rect(product, level, x0, y0, width, height).select("x", "y", value)
    return places.join(have, ["x", "y"], "left").withColumn(value, F.coalesce(value, F.lit(nodata)))


def resident(stored: DataFrame, derived: DataFrame, top: int) -> DataFrame:
    """level, x, y, h: stored levels up to ``top`` and derived ones above it."""
    return stored.where(F.col("level") <= top).select("level", "x", "y", "h").unionByName(derived.where(F.col("level") > top).select("level", "x", "y", "h"))


def read_manifest(spark: SparkSession, root: str, product: str) -> dict:
    return check(spark.read.schema(MANIFEST).json(f"{root}/{product}/manifest").first().asDict())


def read_product(spark: SparkSession, root: str, product: str) -> DataFrame:
    read_manifest(spark, root, product)
    return spark.read.parquet(f"{root}/{product}/cells")


def read_rect(product: DataFrame, level: int, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Cells of a rectangle: the level prunes partitions, tile and texel ranges reach the scan."""
    box = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    tiles = F.col("tx").between(x0 // TILE, (x0 + width - 1) // TILE) & F.col("ty").between(y0 // TILE, (y0 + height - 1) // TILE)
    return product.where((F.col("level") == level) & tiles & box)


def new_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, length) rows that a copy still has to make."""
    return source.join(target, ["path", "length"], "left_anti")
