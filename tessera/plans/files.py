"""Queries that write the tables into files of other formats and read these back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..sources import pbf
from ..staging import shared_dir
from .embeddings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def map_elements(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as nodes, orders as ways over the parts of their lineitems, customers as relations of their orders."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l")).select("id", F.col("l.l_partkey").alias("refs"))
    orders = table(spark, d, "orders")
    ways = orders.withColumnRenamed("o_orderkey", "id").join(line, "id", "left").select("id", F.coalesce("refs", F.array().cast("array<long>")).alias("refs"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("tags"))
    member = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("role"))
    members = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    customers = table(spark, d, "customer").selectExpr("c_custkey as id", "map('segment', c_mktsegment, 'name', c_name) as tags")
    nodes = table(spark, d, "part").selectExpr("p_partkey as id", "p_retailprice / 100 as lat", "cast(-p_size as double) as lon", "map('brand', p_brand) as tags")
    return {"node": nodes, "way": ways, "relation": customers.join(members, "id").select("id", "members", "tags")}


@query("""
with member as (select distinct o_orderkey as id from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'),
w as (select o_orderkey as way, o_orderstatus = 'P' as own from orders where o_orderstatus = 'P' or o_orderkey in (select id from member))
select way, own, count(l_partkey) as refs, count(p_partkey) as found, round(coalesce(sum(p_retailprice / 100), 0), 3) + 0.0 as lat, coalesce(min(-p_size), 0)::double as lon
from w left join lineitem on l_orderkey = way left join part on p_partkey = l_partkey group by 1, 2""")
def osm_extract(spark: SparkSession, d: str) -> DataFrame:
    """All elements as PBF files, written and read by tasks; then the ways that matter, or that relations ask for, with the places of their nodes."""
    pbf.register(spark)
    at = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # files, and so tasks, that grow with the cluster's settings and are not merged again
    for kind, df in map_elements(spark, d).items():
        df.repartition(parts, "id").sortWithinPartitions("id").write.format("osm_pbf").mode("append").option("kind", kind).save(at)
    got = extract(lambda kind: spark.read.format("osm_pbf").option("kind", kind).load(at), F.col("tags")["status"] == "P", F.col("tags")["segment"] == "BUILDING")
    points = got["way"].select(F.col("id").alias("way"), "own", F.explode_outer("refs").alias("id")).join(got["node"].select("id", "lat", "lon"), "id", "left")
    return points.groupBy("way", "own").agg(F.count("id").alias("refs"), F.count("lat").alias("found"), (F.round(F.coalesce(F.sum("lat"), F.lit(0.0)), 3) + 0.0).alias("lat"), F.coalesce(F.min("lon"), F.lit(0.0)).alias("lon"))
