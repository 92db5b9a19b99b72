"""What an extract holds for a map: ways that matter by themselves, those that relations that matter ask for, and the nodes of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract(read: Callable[[str], DataFrame], way: Column, relation: Column) -> dict[str, DataFrame]:
    """relation, way (with ``own``: wanted by itself) and node, each by one pass over ``read(kind)``.

    ``way`` and ``relation`` judge tags.  Relations come first, as their members
    decide on ways; the nodes that some kept way refers to come last.  Both
    later passes are semi joins, so nothing is gathered.
    """
    relations = read("relation").where(relation)
    members = relations.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()
    asked = members.withColumn("asked", F.lit(True))
    ways = read("way").withColumn("own", F.coalesce(way, F.lit(False))).join(asked, "id", "left").where("own or asked").drop("asked")
    wanted = ways.select(F.explode("refs").alias("id")).distinct()
    nodes = read("node").join(wanted, "id", "left_semi")
    return {"relation": relations, "way": ways, "node": nodes}
