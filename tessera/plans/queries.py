"""A query for each operator over the embedded tables, with its oracle where SQL can say the same."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, crs, grid, materials, noise, text
from ..operators import fill, metrics, pyramid, rays, terrain, tiles, vector
from ..staging import shared_dir
from ..streaming import track
from .embeddings import CELLS, IDS, POINTS, RECTS, TIERS, WIDE, cells, ids, points, rectangles, table, tiers, wide_cover

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- grid ------------------------------------------------------------------


@query(f"with {POINTS} select o_orderkey, cast(floor(e / (512 * pow(2, level))) as int) as tx, cast(floor(-n / (512 * pow(2, level))) as int) as ty from points")
def tile_of_point(spark: SparkSession, d: str) -> DataFrame:
    tx, ty = grid.tile_of_metres(F.col("level"), F.col("e"), F.col("n"))
    return points(spark, d).select("o_orderkey", tx.alias("tx"), ty.alias("ty"))


@query(
    f"""with {POINTS}, t as (select o_orderkey, level, cast(floor(e / (512 * pow(2, level))) as int) as tx, cast(floor(-n / (512 * pow(2, level))) as int) as ty from points)
    select o_orderkey, tx * 512 * pow(2, level) as oe, 0 - ty * 512 * pow(2, level) as origin_n, printf('%02d/%d_%d.tif', level, tx, ty) as path from t"""
)
def tile_origin_path(spark: SparkSession, d: str) -> DataFrame:
    tx, ty = grid.tile_of_metres(F.col("level"), F.col("e"), F.col("n"))
    t = points(spark, d).select("o_orderkey", "level", tx.alias("tx"), ty.alias("ty"))
    e, n = grid.tile_origin_metres(F.col("level"), F.col("tx"), F.col("ty"))
    return t.select("o_orderkey", e.alias("oe"), (n + 0.0).alias("origin_n"), grid.tile_path(F.col("level"), F.col("tx"), F.col("ty")).alias("path"))


@query("""select l_orderkey, l_linenumber, cast(floor((l_orderkey - 30000) / 512.0) as bigint) as tx, cast(floor((l_partkey * 7 - 5000) / 512.0) as bigint) as ty,
  (((l_orderkey - 30000) % 512) + 512) % 512 as ix, (((l_partkey * 7 - 5000) % 512) + 512) % 512 as iy from lineitem""")
def tile_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    tx, ty, ix, iy = grid.tile_of_texel(F.expr("l_orderkey - 30000"), F.expr("l_partkey * 7 - 5000"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.alias("tx"), ty.alias("ty"), ix.alias("ix"), iy.alias("iy"))


_TILES = f"with {POINTS}, t as (select distinct cast(floor(e / 4096) as int) as tx, cast(floor(-n / 4096) as int) as ty from points)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    tx, ty = grid.tile_of_metres(3, F.col("e"), F.col("n"))
    return points(spark, d).select(tx.alias("tx"), ty.alias("ty")).distinct()


@query(_TILES + " select tx, ty, cast(k as int) as child, tx * 2 + cast(k % 2 as int) as cx, ty * 2 + cast(k // 2 as int) as cy from t, range(4) r(k)")
def tile_children(spark: SparkSession, d: str) -> DataFrame:
    return grid.children(_tiles(spark, d))


@query(_TILES + " select cast(k as int) as up, cast(floor(tx / pow(2, k)) as int) as ax, cast(floor(ty / pow(2, k)) as int) as ay, count(*) as n from t, range(6) r(k) group by 1, 2, 3")
def tile_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return grid.ancestors(_tiles(spark, d), 5).groupBy("up", "ax", "ay").agg(F.count(F.lit(1)).alias("n"))


@query("select l_suppkey, cast(floor((l_orderkey - 7000) / 512.0) as bigint) as tile, min(l_orderkey - 7000) as first, max(l_orderkey - 7000) as last, count(*) as n from lineitem group by 1, 2")
def strip_runs(spark: SparkSession, d: str) -> DataFrame:
    return grid.strip_runs(table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey - 7000 as i"), "i", "l_suppkey")


@query(f"with {POINTS} select o_orderkey, cast(floor(e / 8192) as bigint) as first, cast(greatest(ceil((e + o_orderkey % 9000) / 8192), floor(e / 8192) + 1) as bigint) as stop from points")
def snap_outward(spark: SparkSession, d: str) -> DataFrame:
    low, high = grid.snap_outward(F.col("e"), F.expr("e + o_orderkey % 9000"))
    return points(spark, d).select("o_orderkey", low.alias("first"), high.alias("stop"))


@query(f"with {POINTS} select o_orderkey, cast(floor(log2(greatest(abs(e) * 0.001, 1.0))) as int) as detail, least(greatest(level, 2), 4) as stored from points")
def level_choice(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("o_orderkey", grid.detail_level(F.abs("e"), 0.001).alias("detail"), grid.stored_level(F.col("level"), 2, 4)[0].alias("stored"))


@query("""with recursive up as (
  select c_custkey, 'n' || c_nationkey as node, 1 as depth from customer
  union all select up.c_custkey, 'r' || n.n_regionkey, up.depth + 1 from up join nation n on up.node = 'n' || n.n_nationkey)
select c_custkey, max(depth) as depth, max(case when depth = 2 then node end) as root from up group by 1""")
def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"chain_{t}")
    # The chains of the nodes that customers start from, once each: what recursion may return is limited.
    return spark.sql("""with recursive up(start, node, depth) as (
      select node, node, 1 from (select distinct concat('n', c_nationkey) as node from chain_customer)
      union all select up.start, concat('r', n.n_regionkey), up.depth + 1 from up join chain_nation n on up.node = concat('n', n.n_nationkey)),
    chains as (select start, max(depth) as depth, max(case when depth = 2 then node end) as root from up group by start)
    select c_custkey, max(depth) as depth, max(root) as root from chain_customer join chains on concat('n', c_nationkey) <=> start group by c_custkey""")


_LAMBERT = f"""select s_suppkey, round(r * sin(theta), 3) as x, round({crs._R0!r}e0 - r * cos(theta), 3) as y from (
 select s_suppkey, {crs._N!r}e0 * radians(lon + 95.0) as theta,
  {crs.A!r}e0 * {crs._C!r}e0 * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {crs._E!r}e0 * sin(radians(lat))) / (1 + {crs._E!r}e0 * sin(radians(lat))), {crs._E / 2!r}e0), {crs._N!r}e0) as r
 from (select s_suppkey, -140.0 + s_suppkey % 90 as lon, 43.0 + s_nationkey as lat from supplier))"""


@query(_LAMBERT)
def lambert_project(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").selectExpr("s_suppkey", "-140.0D + s_suppkey % 90 as lon", "43.0D + s_nationkey as lat")
    x, y = crs.lambert(F.col("lon"), F.col("lat"))
    return t.select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""select s_suppkey, round(6378137.0 * radians(-140.0 + s_suppkey % 90), 3) as x, round(6378137.0 * ln(tan(pi() / 4 + radians(43.0 + s_nationkey) / 2)), 3) as y from supplier""")
def mercator_project(spark: SparkSession, d: str) -> DataFrame:
    x, y = crs.mercator(F.expr("-140.0D + s_suppkey % 90"), F.expr("43.0D + s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# --- pyramids --------------------------------------------------------------


@query(f"with {CELLS} select x // 2 as x, y // 2 as y, cast(sum(h) as bigint) as total, count(*) as n from cells group by 1, 2")
def mip_mean(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mean_parts(cells(spark, d))


@query(
    f"""with {CELLS}, k as (select x // 2 as x, y // 2 as y, {", ".join(f"max(case when x % 2 + y % 2 * 2 = {i} then cast(h as float) end) as c{i}" for i in range(4))} from cells group by 1, 2)
    select x, y, cast(cast(cast(cast(coalesce(c0, 0) + coalesce(c1, 0) as float) + coalesce(c2, 0) as float) + coalesce(c3, 0) as float)
      / cast((c0 is not null)::int + (c1 is not null)::int + (c2 is not null)::int + (c3 is not null)::int as double) as float) as h from k"""
)
def mip_mean_f32(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mean_f32(cells(spark, d))


_LINEAR = "case when {0} / 255.0 <= 0.04045 then {0} / 255.0 / 12.92 else pow(({0} / 255.0 + 0.055) / 1.055, 2.4) end"
_BYTE = "cast(least(greatest(round(255.0 * case when {0} <= 0.0031308 then {0} * 12.92 else 1.055 * pow({0}, 1 / 2.4) - 0.055 end), 0), 255) as int)"


@query(
    f"""with {CELLS}, c as (select x, y, h % 256 as r, h // 256 % 256 as g, x * y % 256 as b from cells),
    m as (select x // 2 as x, y // 2 as y, {", ".join(f"avg({_LINEAR.format(k)}) as {k}" for k in "rgb")} from c where r <> 0 or g <> 0 or b <> 0 group by 1, 2)
    select x, y, {", ".join(f"{_BYTE.format(k)} as {k}" for k in "rgb")} from m"""
)
def mip_colour(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mean_colour(cells(spark, d).selectExpr("x", "y", "h % 256 as r", "h div 256 % 256 as g", "x * y % 256 as b"))


_MODE = """with {i}, n as (select x // 4 as x, y // 4 as y, id, any_value(prec) as prec, count(*) as n from ids where id <> 0 group by 1, 2, 3),
 r as (select *, row_number() over (partition by x, y order by n desc, {o} id) as k from n) select x, y, id, n from r where k = 1"""


@query(_MODE.format(i=IDS, o="prec desc,"))
def mip_mode(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mode(ids(spark, d), precedence="prec", steps=2)


@query(_MODE.format(i=IDS, o=""))
def mip_mode_tail(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mode(ids(spark, d), steps=2)


_QUAD = "select x - dx as x, y - dy as y, max(h) as h from {0}, (values (0), (1)) a(dx), (values (0), (1)) b(dy) group by 1, 2"


@query(f"with {CELLS} {_QUAD.format('cells')}")
def quad_max(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.quad_max(cells(spark, d))


@query(f"with {CELLS} select x // 2 as x, y // 2 as y, max(h) as h from cells group by 1, 2")
def reduce_max(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.reduce_max(cells(spark, d))


@query(
    f"""with {CELLS}, l1 as (select x // 2 as x, y // 2 as y, cast(sum(h) as bigint) // count(*) as h from cells group by 1, 2),
    m0 as ({_QUAD.format("cells")}), q1 as ({_QUAD.format("l1")}),
    m1 as (select x, y, max(h) as h from (select cast(floor(x / 2.0) as bigint) as x, cast(floor(y / 2.0) as bigint) as y, h from m0 union all select * from q1) group by 1, 2)
    select 0 as depth, x, y, h from m0 union all select 1, x, y, h from m1"""
)
def max_pyramid(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d)
    above = pyramid.mean_parts(base).selectExpr("x", "y", "total div n as h")
    return pyramid.max_pyramid([base, above]).select("depth", "x", "y", "h")


@query(f"with {CELLS} select cast(k as int) as level, x // cast(pow(2, k) as bigint) as x, y // cast(pow(2, k) as bigint) as y, max(h) as h from cells, range(7) r(k) group by 1, 2, 3")
def level_tail(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.build_levels(cells(spark, d), 7)


@query(f"with {CELLS} select coalesce(min(h), 0) as low, coalesce(max(h), 0) as high from cells")
def value_range(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.value_range(cells(spark, d))


@query(f"with {IDS} select id, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from ids group by 1 order by n desc, id limit 5")
def material_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.histogram(ids(spark, d), top=5).withColumn("share", F.round("share", 6))


# --- filling ---------------------------------------------------------------


@query(f"with {TIERS} select x, y, h, tier from filled")
def tier_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill.tier_fill(tiers(spark, d))


@query(
    f"""with {TIERS}, t as (select count(*) filter (tier = 1) as tier_1, count(*) filter (tier = 2) as tier_2, count(*) filter (tier = 3) as tier_3, 4096 - count(*) as missing from filled)
    select *, round(tier_1 * 100.0 / 4096, 6) as tier_1_percent, round(tier_2 * 100.0 / 4096, 6) as tier_2_percent, round(tier_3 * 100.0 / 4096, 6) as tier_3_percent, round(missing * 100.0 / 4096, 6) as missing_percent from t"""
)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return fill.provenance_tally(fill.tier_fill(tiers(spark, d)), 3, 4096)


@query(
    f"""with {TIERS}, t as (select count(*) filter (tier = 1) as tier_1, count(*) filter (tier = 2) as tier_2, count(*) filter (tier = 3) as tier_3 from filled where x % 5 = 0 and y % 5 = 0)
    select cast(169 as bigint) as sampled, *, 169 - tier_1 - tier_2 - tier_3 as missing, round(1 - tier_1 / cast(169 as double), 6) as unsurveyed from t"""
)
def coverage_estimate(spark: SparkSession, d: str) -> DataFrame:
    return fill.coverage_estimate(fill.tier_fill(tiers(spark, d)), 5, 64, 64, 3)


_GRID = "g as (select a as x, b as y from range({0}, {2}) p(a), range({1}, {3}) q(b))"


@query(f"with {CELLS}, {_GRID.format(0, 0, 64, 64)}, o as (select * from g anti join cells using (x, y)) select greatest(min(x) - 2, 0) as x0, greatest(min(y) - 2, 0) as y0, least(max(x) + 2, 63) as x1, least(max(y) + 2, 63) as y1, count(*) as holes from o")
def hole_extent(spark: SparkSession, d: str) -> DataFrame:
    return fill.hole_extent(cells(spark, d), 0, 0, 64, 64, 2)


@query(f"with {CELLS}, {_GRID.format(-4, -4, 70, 20)} select g.x, g.y, c.h from g left join cells c on c.x = least(greatest(g.x, 0), 63) and c.y = least(greatest(g.y, 0), 63)")
def window_read(spark: SparkSession, d: str) -> DataFrame:
    return fill.window_read(cells(spark, d), -4, -4, 70, 20, (0, 0, 63, 63))


_AT = "p as (select o_orderkey, o_custkey % 63 + o_orderkey % 4 / 4.0 as px, o_orderkey % 61 + o_custkey % 8 / 8.0 as py from orders)"


@query(
    f"""with {CELLS}, {_AT}, w as (select o_orderkey, cast(floor(px) as bigint) + dx as x, cast(floor(py) as bigint) + dy as y,
      (case dx when 1 then px - floor(px) else 1 - px + floor(px) end) * (case dy when 1 then py - floor(py) else 1 - py + floor(py) end) as w
      from p, (values (0), (1)) a(dx), (values (0), (1)) b(dy))
    select o_orderkey, round(sum(w * h), 4) as h from w join cells using (x, y) group by 1 having count(*) = 4"""
)
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 63 + o_orderkey % 4 / 4.0D as px", "o_orderkey % 61 + o_custkey % 8 / 8.0D as py")
    return fill.bilinear(p, cells(spark, d), "px", "py", ("o_orderkey",)).withColumn("h", F.round("h", 4))


_COPIES = "select l_orderkey % 64 as x, l_partkey % 64 as y, l_orderkey * 8 + l_linenumber as o, cast(round(l_extendedprice * 100) as bigint) as h from lineitem"


@query(f"with c as ({_COPIES}), m as (select x, y, arg_min(h, struct_pack(o := o, h := h)) as first_h, arg_max(h, struct_pack(o := o, h := h)) as last_h from c group by 1, 2) select * from m")
def aligned_copy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").selectExpr("l_orderkey % 64 as x", "l_partkey % 64 as y", "struct(l_orderkey * 8 + l_linenumber as o, cast(round(l_extendedprice * 100) as bigint) as h) as k", "cast(round(l_extendedprice * 100) as bigint) as h")
    a = fill.first_wins(c, "k").withColumnRenamed("h", "first_h")
    return a.join(fill.last_wins(c, "k").withColumnRenamed("h", "last_h"), ["x", "y"])


# --- cover and vectors -----------------------------------------------------


@query("""with t as (select event_id, ['wood', 'scrub', 'water', 'cliff', null][event_id % 5 + 1] as nat, ['forest', 'quarry', null][event_id % 3 + 1] as land,
  case when event_id % 2 = 0 then 'mixed' end as leaf, case when event_id % 11 = 0 then 'no' end as area, case when event_id % 7 = 0 then 'lake' end as water from events)
select event_id, case when area = 'no' then null when water is not null then 257
  when nat = 'wood' then case when leaf = 'mixed' then 770 else 1023 end when nat = 'scrub' then 1024 when nat = 'water' then 511 when nat is not null then null
  when land = 'forest' then case when leaf = 'mixed' then 770 else 1023 end when land = 'quarry' then 1804 end as id from t""")
def classify_tags(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda k, n, *v: F.struct(F.lit(k).alias("k"), F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int")).alias("v"))
    tags = F.array(pick("natural", 5, "wood", "scrub", "water", "cliff", None), pick("landuse", 3, "forest", "quarry", None), pick("leaf_type", 2, "mixed", None), pick("area", 11, "no", *[None] * 10), pick("water", 7, "lake", *[None] * 6))
    return table(spark, d, "events").select("event_id", materials.classify(F.map_from_entries(F.filter(tags, lambda t: t["v"].isNotNull()))).alias("id"))


@query("""with t as (select event_id, ['motorway', 'track', 'path', 'service', 'steps'][event_id % 5 + 1] as hw, ['gravel', 'asphalt', null][event_id % 3 + 1] as surface, event_id % 7 = 0 as bridge from events)
select event_id, case when bridge or hw = 'steps' then null when hw = 'path' or surface = 'gravel' or (hw = 'track' and surface is null) then 1286 else 1806 end as material,
 case when bridge or hw = 'steps' then null when hw = 'motorway' then 22 when hw = 'track' then 3.5 when hw = 'path' then 2 else 4 end::double as width from t""")
def carriageway(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda k, n, *v: F.struct(F.lit(k).alias("k"), F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int")).alias("v"))
    tags = F.array(pick("highway", 5, "motorway", "track", "path", "service", "steps"), pick("surface", 3, "gravel", "asphalt", None), pick("bridge", 7, "yes", *[None] * 6))
    line = materials.carriageway(F.map_from_entries(F.filter(tags, lambda t: t["v"].isNotNull())))
    return table(spark, d, "events").select("event_id", line.alias("l")).select("event_id", "l.material", "l.width")


def _ways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ways through nodes whose ids skip every eleventh number, so that some references find none."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"])
    ways = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(refs.alias("refs"))
    return ways, table(spark, d, "part").selectExpr("p_partkey + p_partkey div 10 as node", "cast(p_size * 10 as double) as x", "cast(p_partkey % 97 as double) as y")


@query("""with p as (select l_orderkey as way, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, p_size * 10 as x, p_partkey % 97 as y
  from lineitem left join part on p_partkey + p_partkey // 10 = l_partkey),
 r as (select *, sum((x is null)::int) over (partition by way order by pos) as run from p),
 s as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from r where x is not null window w as (partition by way, run order by pos))
select way, cast(run as bigint) as run, cast(min(pos) as int) as first, cast(max(pos) as int) as last, count(*) as n, round(coalesce(sum(step), 0), 5) as length from s group by 1, 2 having count(*) >= 2""")
def resolve_ways(spark: SparkSession, d: str) -> DataFrame:
    return vector.strokes(vector.resolve(*_ways(spark, d))).withColumn("length", F.round("length", 5))


@query("select o_custkey as relation, count(*) as members, count(*) filter (o_orderstatus = 'P') as missing from orders group by 1")
def relation_members(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rel = o.groupBy(F.col("o_custkey").alias("relation")).agg(F.collect_list("o_orderkey").alias("members"))
    return vector.relation_members(rel, o.where("o_orderstatus <> 'P'").selectExpr("o_orderkey as way"))


@query(f"select ring, cast(case when ring % 2 = 1 then w * t else -w * t end as double) as area, cx as x0, cy as y0, cx + w as x1, cy + t as y1 from ({RECTS})")
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    return vector.ring_area(vector.ring_edges(rectangles(spark, d)))


@query(f"""with s as (select s_suppkey, s_suppkey % 130 + 0.25 as px, s_nationkey * 3 + 0.5 as py from supplier)
select s_suppkey, ring from s join ({RECTS}) on px > cx and px < cx + w and py > cy and py < cy + t""")
def point_in_ring(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 130 + 0.25D as px", "s_nationkey * 3 + 0.5D as py")
    return vector.points_in_rings(p, vector.ring_edges(rectangles(spark, d)), 4, ("s_suppkey",))


@query(f"select ring, cast(w * t as bigint) as n, cast(t * (w * cx + w * (w - 1) // 2) as bigint) as sx, cast(w * (t * cy + t * (t - 1) // 2) as bigint) as sy from ({RECTS})")
def polygon_scan_convert(spark: SparkSession, d: str) -> DataFrame:
    return vector.scan_convert(vector.ring_edges(rectangles(spark, d))).groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""with r as ({RECTS}), c as (select cx + a as x, cy + b as y, ring, ring % 6 as layer, w * t as area from r, range(60) p(a), range(12) q(b) where a < w and b < t),
 k as (select *, row_number() over (partition by x, y order by layer desc, area, ring desc) as k from c) select x, y, ring as id from k where k = 1""")
def painter_order(spark: SparkSession, d: str) -> DataFrame:
    covers = vector.scan_convert(vector.ring_edges(rectangles(spark, d)))
    own = table(spark, d, "part").selectExpr("p_partkey as ring", "p_partkey % 6 as layer", "p_size * (p_size % 9 + 1) as area", "p_partkey as index", "p_partkey as id")
    return vector.paint(covers.join(own, "ring"))


@query("""with s as (select s_suppkey, s_suppkey % 50 + 0.5 as x, s_nationkey + 0.25 as y, s_suppkey % 50 + 0.5 + s_suppkey % 7 as nx, s_nationkey + 0.25 + s_suppkey % 5 as ny from supplier),
 c as (select *, cx + 0.5 - x as px, cy + 0.5 - y as py, nx - x as dx, ny - y as dy from s, range(-3, 62) p(cx), range(-3, 35) q(cy)),
 t as (select *, least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) as t from c where dx <> 0 or dy <> 0)
select s_suppkey as stroke, cx as x, cy as y from t where pow(px - t * dx, 2) + pow(py - t * dy, 2) <= 2.25""")
def stroke_scan_convert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("s_suppkey as stroke", "s_suppkey % 50 + 0.5D as x", "s_nationkey + 0.25D as y", "s_suppkey % 50 + 0.5D + s_suppkey % 7 as nx", "s_nationkey + 0.25D + s_suppkey % 5 as ny", "3.0D as w")
    return vector.stroke_convert(s)


@query("""with s as (select o_orderkey, o_custkey % 200 - 60.0 as x0, o_orderkey % 150 - 30.0 as y0, o_custkey % 170 - 40.0 as x1, o_orderkey % 130 - 20.0 as y1 from orders),
 e as (select *, x1 - x0 as dx, y1 - y0 as dy from s),
 t as (select *, greatest(0.0, case when dx > 0 then (0 - x0) / dx when dx < 0 then (100 - x0) / dx else 0 end, case when dy > 0 then (0 - y0) / dy when dy < 0 then (80 - y0) / dy else 0 end) as a,
   least(1.0, case when dx > 0 then (100 - x0) / dx when dx < 0 then (0 - x0) / dx else 1 end, case when dy > 0 then (80 - y0) / dy when dy < 0 then (0 - y0) / dy else 1 end) as b,
   (dx <> 0 or x0 between 0 and 100) and (dy <> 0 or y0 between 0 and 80) as ok from e)
select o_orderkey, case when ok and a <= b then cast(round(a, 8) as double) end as t0, case when ok and a <= b then cast(round(b, 8) as double) end as t1 from t""")
def segment_clip(spark: SparkSession, d: str) -> DataFrame:
    x = [F.expr(e) for e in ("o_custkey % 200 - 60.0D", "o_orderkey % 150 - 30.0D", "o_custkey % 170 - 40.0D", "o_orderkey % 130 - 20.0D")]
    a, b = vector.clip_segment(*x, (0.0, 0.0, 100.0, 80.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(a, 8).alias("t0"), F.round(b, 8).alias("t1"))


#: Cover of the mapped cells, an eighth of it water; holes have id 0.
_COVER = "case when h is null then 0 when h % 8 = 0 then 511 when h % 8 < 4 then 1023 else 1804 end"
#: 4000 m at 4 m a cell, 3 a side.
_FILL_LIMIT = 3000


def _filled(spark: SparkSession, d: str) -> DataFrame:
    lattice = spark.range(4096).selectExpr("id % 64 as x", "id div 64 as y")
    cover = lattice.join(cells(spark, d), ["x", "y"], "left").selectExpr("x", "y", f"cast({_COVER} as long) as id")
    return tiles.nearest_fill(cover, _FILL_LIMIT, 32)


@query(f"""with {CELLS}, {_GRID.format(0, 0, 64, 64)}, s as (select x, y from cells where {_COVER} not in (0, 511)),
 n as (select g.x, g.y, min(3 * greatest(abs(g.x - s.x), abs(g.y - s.y)) + least(abs(g.x - s.x), abs(g.y - s.y))) as distance from g left join s on true group by 1, 2)
select x, y, case when distance <= {_FILL_LIMIT} then distance end as distance from n""")
def nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("x", "y", "distance")


#: 60 m at 4 m a cell, 3 a side: what the SQL can search around every cell.
_NEAR_LIMIT = 45


@query(f"""with {WIDE}, s as (select x, y from wide where id not in (0, 511)),
 n as (select x + i as x, y + j as y, min(3 * greatest(abs(i), abs(j)) + least(abs(i), abs(j))) as distance from s, range(-15, 16) a(i), range(-15, 16) b(j) group by 1, 2)
select x, y, case when distance <= {_NEAR_LIMIT} then distance end as distance from wide left join n using (x, y)""")
def nearest_fill_wide(spark: SparkSession, d: str) -> DataFrame:
    cover, box = wide_cover(spark, d)
    return tiles.nearest_fill(cover, _NEAR_LIMIT, box=box).select("x", "y", "distance")


@query()
def nearest_fill_ids(spark: SparkSession, d: str) -> DataFrame:
    cover, box = wide_cover(spark, d)
    return tiles.nearest_fill(cover, _FILL_LIMIT, box=box).select("x", "y", "id")


@query()
def stitch_rings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").selectExpr("l_suppkey as relation", "l_orderkey * 8 + l_linenumber as pos", "array(l_orderkey % 40, l_partkey % 40) as refs")
    return vector.stitch_rings(o)


# --- noise, stencils, flow -------------------------------------------------

def _sql_mix(b: str, out: str, source: str) -> str:
    return f"""select *, m3 ^ (m3 >> 16) as {out} from (select *, cast(cast(xor(m2, m2 >> 15) as hugeint) * 2221713035 % 4294967296 as bigint) as m3 from (
      select *, cast(cast(xor({b}, {b} >> 16) as hugeint) * 2146121005 % 4294967296 as bigint) as m2 from {source}))""".replace("m3 ^ (m3 >> 16)", "xor(m3, m3 >> 16)")


@query(
    f"""with a as (select l_orderkey, l_linenumber, xor(cast(7::hugeint * 2654435761 % 4294967296 as bigint), cast((((l_orderkey - 3000)::hugeint + 4294967296) % 4294967296) * 889516851 % 4294967296 as bigint)) as b0,
      cast((((l_partkey)::hugeint + 4294967296) % 4294967296) * 4055616971 % 4294967296 as bigint) as yy from lineitem),
    m as ({_sql_mix("b0", "b1", "a")}), n as (select l_orderkey, l_linenumber, xor(b1, yy) as b2 from m), o as ({_sql_mix("b2", "word", "n")})
    select l_orderkey, l_linenumber, word, (word >> 8) / 16777216.0::double as unit from o"""
)
def hash_noise(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.expr("l_orderkey - 3000"), F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", noise.lattice_hash(x, y, 7).alias("word"), noise.hash_unit(x, y, 7).alias("unit"))


@query()
def fractal_noise(spark: SparkSession, d: str) -> DataFrame:
    f = noise.Fractal(48.0, 4).band_limited(4.0)
    x, y = F.col("x").cast("double") + 0.3, F.col("y").cast("double") + 0.7
    wx, wy = noise.warp(x, y, 5, noise.Fractal(64.0, 2), 6.0)
    c = cells(spark, d).select("x", "y", wx.alias("wx"), wy.alias("wy"))
    return c.select("x", "y", noise.fbm(F.col("wx"), F.col("wy"), 1, f).alias("fbm"), noise.billow(x, y, 2, f).alias("billow"), noise.ridged(x, y, 3, f).alias("ridged"), noise.value(x / 9.0, y / 9.0, 4).alias("value"))


@query("""select px, py, rank, rank < 19 as dropped from (select px, py, cast(sum(((((px >> k) & 1) + ((py >> k) & 1)) % 2 * 2 + ((py >> k) & 1)) * pow(4, 2 - k)) as int) as rank
 from (select distinct l_orderkey % 8 as px, l_partkey % 8 as py from lineitem), range(3) r(k) group by 1, 2)""")
def bayer_drop(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").selectExpr("l_orderkey % 8 as px", "l_partkey % 8 as py").distinct()
    return p.withColumn("rank", noise.bayer_rank(F.col("px"), F.col("py"))).withColumn("dropped", F.col("rank") < 19)


_SIDES = "(select c.*, w.h as n0, e.h as n1, n.h as n2, s.h as n3 from cells c left join cells w on w.x = c.x - 1 and w.y = c.y left join cells e on e.x = c.x + 1 and e.y = c.y left join cells n on n.x = c.x and n.y = c.y - 1 left join cells s on s.x = c.x and s.y = c.y + 1)"


_EIGHT = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]
_BEND = " + ".join(f"{1.0 if k < 4 else 0.5}::double * (coalesce(n{k}, 2 * h - n{o}, h) - h)" for k, o in enumerate((1, 0, 3, 2, 7, 6, 5, 4)))
_AROUND = "(select c.*, " + ", ".join(f"a{k}.h as n{k}" for k in range(8)) + " from cells c " + " ".join(f"left join cells a{k} on a{k}.x = c.x + {dx} and a{k}.y = c.y + {dy}" for k, (dx, dy) in enumerate(_EIGHT)) + ")"


@query(f"with {CELLS} select x, y, round(h + 0.1::double * ({_BEND}) / 2, 3) as h from {_AROUND}")
def creep_step(spark: SparkSession, d: str) -> DataFrame:
    return terrain.creep(cells(spark, d), 0.1).withColumn("h", F.round("h", 3))


_NEAR = """near as (select c.x, c.y, c.h, o.h as other, slot, case when slot < 4 then 1.0::double else sqrt(2) end as reach
  from cells c, (values (-1, 0, 0), (1, 0, 1), (0, -1, 2), (0, 1, 3), (-1, -1, 4), (1, -1, 5), (-1, 1, 6), (1, 1, 7)) v(dx, dy, slot) join cells o on o.x = c.x + dx and o.y = c.y + dy)"""


@query(f"with {CELLS}, {_NEAR}, r as (select *, (h - other) / reach as fall, row_number() over (partition by x, y order by (h - other) / reach desc, slot) as k from near where h > other) select x, y, slot, round(fall, 4) as fall from r where k = 1")
def receiver_d8(spark: SparkSession, d: str) -> DataFrame:
    return terrain.receivers(cells(spark, d)).withColumn("fall", F.round("fall", 4))


@query(f"""with {CELLS}, {_NEAR}, e as (select *, greatest(h - other - 5000 * reach, 0) as excess from near), s as (select x, y, max(excess) / 2 as out, sum(excess) as total from e group by 1, 2),
 m as (select e.x + dx as x, e.y + dy as y, sum(case when total > 0 then out * excess / total else 0 end) as got from e join s using (x, y)
   join (values (-1, 0, 0), (1, 0, 1), (0, -1, 2), (0, 1, 3), (-1, -1, 4), (1, -1, 5), (-1, 1, 6), (1, 1, 7)) v(dx, dy, slot) using (slot) where excess > 0 group by 1, 2)
select c.x, c.y, round(c.h - coalesce(s.out, 0) + coalesce(m.got, 0), 3) as h from cells c left join s using (x, y) left join m on m.x = c.x and m.y = c.y""")
def thermal_step(spark: SparkSession, d: str) -> DataFrame:
    return terrain.thermal(cells(spark, d), 5000.0).withColumn("h", F.round("h", 3))


@query(f"""with {CELLS}, g as (select x, y, case when n0 is null and n1 is null then 0 else (coalesce(n1, h) - coalesce(n0, h)) / (((n0 is not null)::int + (n1 is not null)::int) * 100000.0::double) end as gx,
 case when n2 is null and n3 is null then 0 else (coalesce(n3, h) - coalesce(n2, h)) / (((n2 is not null)::int + (n3 is not null)::int) * 100000.0::double) end as gy from {_SIDES})
select x, y, round(0 - gx / sqrt(gx * gx + gy * gy + 1), 6) + 0 as nx, round(1 / sqrt(gx * gx + gy * gy + 1), 6) as ny, round(0 - gy / sqrt(gx * gx + gy * gy + 1), 6) + 0 as nz from g""")
def surface_normal(spark: SparkSession, d: str) -> DataFrame:
    n = terrain.slope_normal(cells(spark, d), 100000.0)
    return n.select("x", "y", (F.round("nx", 6) + 0).alias("nx"), F.round("ny", 6).alias("ny"), (F.round("nz", 6) + 0).alias("nz"))


@query()
def flow_area(spark: SparkSession, d: str) -> DataFrame:
    return terrain.drainage(cells(spark, d).withColumn("grid", F.expr("x div 32 + 2 * (y div 32)")))


#: The reference's rounds of cutting and of settling, and its droplets a cell.
_ROUNDS = 80 + 12
_DROPLETS = 3


@query()
def incision(spark: SparkSession, d: str) -> DataFrame:
    return terrain.on_grids(cells(spark, d).withColumn("grid", F.expr("x div 32 + 2 * (y div 32)")), lambda h: {"bed": terrain.incise(h, _ROUNDS, 0.01)}, "bed double", "grid")


@query()
def droplet_erosion(spark: SparkSession, d: str) -> DataFrame:
    return terrain.on_grids(cells(spark, d).withColumn("grid", F.expr("x div 32 + 2 * (y div 32)")), lambda h: {"h": terrain.droplets(h, _DROPLETS * h.size)}, "h double", "grid")


@query()
def ray_march(spark: SparkSession, d: str) -> DataFrame:
    """Against the embedded cells with their holes, half a million to a cell's width; some rays start under ground, some fall straight down."""
    h = np.full((64, 64), np.nan)
    for r in cells(spark, d).collect():  # 4096 cells at every scale
        h[r["y"], r["x"]] = r["h"] / 500_000
    r = table(spark, d, "supplier").selectExpr("s_suppkey as ray", "s_suppkey % 60 + 0.5D as ox", "s_nationkey * 2 + 1.25D as oy", "if(s_suppkey % 4 = 0, 6.0D, 25.0D) as oz", "(s_suppkey % 7 - 3) / 4.0D as dx", "(s_suppkey % 5 - 2) / 4.0D as dy", "-0.5D as dz")
    return rays.cast(r, h)


# --- metrics, shading, text, state ----------------------------------------


@query("select event_type, min(value) as least, list_sort(list(value))[cast(count(value) // 2 + 1 as int)] as median, round(avg(value), 6) as mean, count(value) as n from events group by 1")
def stats_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stats(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("select event_type, user_id % 4 as step, cast(sum(event_id) as bigint) as event_id from events group by rollup (event_type, user_id % 4)")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rollup_rows(table(spark, d, "events").withColumn("step", F.col("user_id") % 4), "event_type", "step", "event_id")


@query("""with e as (select user_id, list_sort(list(struct_pack(t := event_id / 10000.0::double, v := value))) as s from events group by 1)
select user_id, round(list_reduce(s, lambda a, r: struct_pack(t := r.t, v := a.v + (1 - exp((a.t - r.t) / 0.25)) * (r.v - a.v))).v, 6) as smoothed from e""")
def ewma(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id", "event_id / 10000.0D as seconds", "value")
    return metrics.ewma(e, "user_id", "seconds", "value").withColumn("smoothed", F.round("smoothed", 6))


@query("select count(*) filter (event_id % 3 = 0) as marched, count(*) filter (event_id % 3 = 1) as carried, count(*) filter (event_id % 3 = 2) as sky, count(*) as pixels from events")
def coverage_tally(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_tally(table(spark, d, "events").selectExpr("element_at(array('marched', 'carried', 'sky'), cast(event_id % 3 + 1 as int)) as path"))


_BLOCKS = "b as (select l_orderkey % 96 // 8 as bx, l_partkey % 96 // 8 as by, max(abs(l_linenumber - 3)) as motion, max(l_extendedprice) as depth from lineitem group by 1, 2)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cell_max(table(spark, d, "lineitem").selectExpr("l_orderkey % 96 as px", "l_partkey % 96 as py", "l_linenumber - 3 as motion", "l_extendedprice as depth"))


@query(f"with {_BLOCKS} select * from b")
def cell_max(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d)


@query(f"with {_BLOCKS} select b.bx + i as bx, b.by + j as by, max(depth) as depth from b, range(-2, 3) p(i), range(-2, 3) q(j) where greatest(abs(i), abs(j)) <= motion group by 1, 2")
def cell_reach(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cell_reach(_blocks(spark, d))


@query("""with p as (select p_partkey, p_size % 3 as k, (p_partkey % 21 - 10) / 10.0 as facing from part), q as (select *, case k when 0 then 1.0 when 1 then 0.5 else 0.2 end as v from p)
select p_partkey, cast(least(greatest(round(255.0 * (case when s <= 0.0031308 then s * 12.92 else 1.055 * pow(s, 1 / 2.4) - 0.055 end)), 0), 255) as int) as grey
from (select p_partkey, cast(v as double) * (0.35 + 0.65 * greatest(facing, 0)) as s from q)""")
def palette_shade(spark: SparkSession, d: str) -> DataFrame:
    palette = spark.createDataFrame([(0, 1.0), (1, 0.5)], "k int, v double")
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size % 3 as k", "(p_partkey % 21 - 10) / 10.0D as facing")
    return p.join(F.broadcast(palette), "k", "left").select("p_partkey", colour.linear_to_srgb(colour.lambert(F.coalesce("v", F.lit(0.2)), F.col("facing"))).alias("grey"))


@query("select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KiB', n / 1024.0::double) when n < 1073741824 then printf('%.1f MiB', n / 1048576.0::double) else printf('%.1f GiB', n / 1073741824.0::double) end as size from (select o_orderkey, o_orderkey * o_orderkey * 97 as n from orders)")
def byte_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.byte_count(F.expr("o_orderkey * o_orderkey * 97"), "GiB").alias("size"))


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query()
def residency_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    steps = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").selectExpr("user_id", "event_id as seq", "value * 40 as x", "(event_id % 997) * 3.0D as y")
    return _drain(track.residency(steps), "residency")


@query()
def smoothed_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    steps = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").selectExpr("user_id", "event_id / 10000.0D as seconds", "value")
    return _drain(track.smoothed(steps), "smoothed")


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is and read what it appended: tasks write it to the shared folder."""
    at = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{at}-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(at)
