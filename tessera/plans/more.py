"""More queries over the embedded tables: borders, nodata rules, ground, views, residency, regions, painting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, grid, ground, nodata, perimeter, view
from ..operators import pyramid, regions, vector
from ..sources import geotiff
from .embeddings import CELLS, POINTS, RECTS, cells, points, rectangles, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- borders ---------------------------------------------------------------

_RECT = perimeter.Rect(0.0, 0.0, 100.0, 60.0)
_BORDER = "b as (select o_orderkey, (o_custkey % 111 - 5)::double as x, (o_orderkey % 67 - 3)::double as y, (o_custkey % 320)::double as a, (o_orderkey * 7 % 320)::double as z from orders)"


def _border(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "cast(o_custkey % 111 - 5 as double) as x", "cast(o_orderkey % 67 - 3 as double) as y", "cast(o_custkey % 320 as double) as a", "cast(o_orderkey * 7 % 320 as double) as z")


@query(f"""with {_BORDER} select o_orderkey, x between 0 and 100 and y between 0 and 60 as inside,
 x between 0 and 100 and y between 0 and 60 and (x = 0 or x = 100 or y = 0 or y = 60) as on_border,
 case when x not between 0 and 100 or y not between 0 and 60 then null when y = 60 then x when x = 100 then 160 - y when y = 0 then 260 - x when x = 0 then 260 + y end as along from b""")
def border_place(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _border(spark, d).select("o_orderkey", _RECT.contains(x, y).alias("inside"), _RECT.on_border(x, y).alias("on_border"), F.when(_RECT.on_border(x, y), _RECT.along(x, y)).alias("along"))


@query(f"""with {_BORDER}, c as (select o_orderkey, a, case when z > a then z - a else z - a + 320 end as span, t, name, case when t > a then t - a else t - a + 320 end as ahead
  from b, (values (100, 'ne'), (160, 'se'), (260, 'sw'), (320, 'nw')) v(t, name))
select o_orderkey, coalesce(string_agg(name, ' ' order by ahead) filter (ahead < span), '') as corners from c group by 1""")
def border_corners(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.when(c["y"] == 60.0, "n").otherwise("s"), F.when(c["x"] == 100.0, "e").otherwise("w"))
    passed = _RECT.corners_between(F.col("a"), F.col("z"))
    return _border(spark, d).select("o_orderkey", F.array_join(F.transform(passed, name), " ").alias("corners"))


@query(f"""with {_BORDER}, e as (select *, least(x, 100 - x, y, 60 - y) as near from b where x between 0 and 100 and y between 0 and 60)
select o_orderkey, case when near > 20 then null when x = near then 0 when 100 - x = near then 100 else x end as bx,
 case when near > 20 then null when x = near or 100 - x = near then y when y = near then 0 else 60 end as by from e""")
def border_nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _RECT.nearest(F.col("x"), F.col("y"), 20.0)
    return _border(spark, d).where(_RECT.contains(F.col("x"), F.col("y"))).select("o_orderkey", p["x"].alias("bx"), p["y"].alias("by"))


# --- nothing and failures --------------------------------------------------


@query("""select l_orderkey, l_linenumber, l_extendedprice - 60000 < -30000 as no_height, l_partkey % 3 = 0 and l_suppkey % 2 = 0 and l_linenumber = 1 as no_colour, l_partkey % 5 = 0 as no_material,
 case when l_quantity > 45 then true else l_partkey * 40 <= 7988 end as empty_tile, case when l_linenumber > 5 then true else 400 + l_partkey % 200 = 429 or 400 + l_partkey % 200 >= 500 end as transient from lineitem""")
def nothing_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    n_bytes = F.when(F.col("l_quantity") <= 45, F.col("l_partkey") * 40)
    status = F.when(F.col("l_linenumber") <= 5, 400 + F.col("l_partkey") % 200)
    return t.select(
        "l_orderkey", "l_linenumber", nodata.no_height(F.col("l_extendedprice") - 60000).alias("no_height"), nodata.no_colour(F.col("l_partkey") % 3, F.col("l_suppkey") % 2, F.col("l_linenumber") - 1).alias("no_colour"),
        nodata.no_material(F.col("l_partkey") % 5).alias("no_material"), nodata.empty_tile(n_bytes, nodata.EMPTY_BYTES["hrdem"]).alias("empty_tile"), nodata.transient(status).alias("transient"),
    )


@query(f"""with {POINTS}, r as (select o_orderkey, level, 512 * pow(2, level) as span, e, n, 1000.0 + o_orderkey % 7000 as w, 500.0 + o_orderkey % 3000 as h from points),
 t as (select o_orderkey, floor(e / span) as ax, floor(-n / span) as ay, floor((e + w - 0.5) / span) as bx, floor(-(n - h + 0.5) / span) as dy from r)
select o_orderkey, cast(ax as int) as tx, cast(ay as int) as ty, cast(bx - ax + 1 as int) as across, cast(dy - ay + 1 as int) as down, cast((bx - ax + 1) * (dy - ay + 1) as bigint) as tiles from t""")
def tiles_of_extent(spark: SparkSession, d: str) -> DataFrame:
    tx, ty, across, down = grid.tile_range(F.col("level"), F.col("e"), F.col("n"), 1000.0 + F.col("o_orderkey") % 7000, 500.0 + F.col("o_orderkey") % 3000)
    return points(spark, d).select("o_orderkey", tx.cast("int").alias("tx"), ty.cast("int").alias("ty"), across.cast("int").alias("across"), down.cast("int").alias("down"), (across.cast("long") * down).alias("tiles"))


# --- ground ----------------------------------------------------------------

_STEP = "least(greatest(({v} - {a}) / ({b} - {a}), 0), 1)"
_SMOOTH = lambda a, b, v: f"({_STEP} * {_STEP} * (3 - 2 * {_STEP}))".format(a=f"{a}::double", b=f"{b}::double", v=v)


@query(f"""with s as (select l_orderkey, l_linenumber, l_discount * 10 as slope, greatest(l_tax * 50 - 1, 0) as depth, l_quantity / 3 as flow, l_partkey % 10 / 10.0::double as hard, l_suppkey % 9 as deposit from lineitem),
 f as (select *, {_SMOOTH(0.25, 0.9, "slope")} as steep, {_SMOOTH(0.4, 2.5, "depth")} as lake, {_SMOOTH(11.5, 15.5, "flow")} as run from s)
select l_orderkey, l_linenumber, round(steep, 9) as steepness, round(steep * (0.35::double + 0.65::double * hard), 9) as rockiness, round({_SMOOTH(0.0, 6.0, "deposit")}, 9) as filling, round(lake, 9) as lake,
 round(run * (1 - lake) * {_SMOOTH(0.5, 1.5, "1.25::double")}, 9) as channel from f""")
def ground_fractions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    depth = ground.water_depth(F.col("l_tax") * 50, F.lit(1.0))
    f = ground.fractions(F.col("l_discount") * 10, depth, F.col("l_quantity") / 3, F.col("l_partkey") % 10 / 10.0, F.col("l_suppkey") % 9, 16.0, 16.0)
    return t.select("l_orderkey", "l_linenumber", *(F.round(v, 9).alias(k) for k, v in f.items()))


@query("select round(avg((l_tax * 100 - 1.5::double > 2.5)::int), 9) as share from lineitem")
def flooded_share(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_tax") * 100).alias("filled"), F.lit(1.5).alias("h"))
    return ground.flooded_share(t).select(F.round("share", 9).alias("share"))


@query(f"with {CELLS}, r as (select min(h) as low, max(h) as high from cells) select x, y, round(200 + (h - low) * (1800.0::double / (high - low)), 6) as h from cells, r")
def relief_rescale(spark: SparkSession, d: str) -> DataFrame:
    return ground.rescale(cells(spark, d), 200.0, 2000.0).select("x", "y", F.round("h", 6).alias("h"))


def _chain(levels: int) -> str:
    slot = lambda i, j: f"max(h) filter (x % 2 = {i} and y % 2 = {j})"
    n = "cast(" + " + ".join(f"({slot(i, j)} is not null)::int" for j in (0, 1) for i in (0, 1)) + " as float)"
    total = " + ".join(f"coalesce({slot(i, j)}, 0::float)" for j in (0, 1) for i in (0, 1))
    out = [f"with {CELLS}, l0 as (select x, y, h::float as h from cells)"]
    out += [f", l{k} as (select x // 2 as x, y // 2 as y, ({total}) / {n} as h from l{k - 1} group by 1, 2)" for k in range(1, levels + 1)]
    return "".join(out) + " union all ".join(f" select {k}::int as level, x, y, h::double as h from l{k}" for k in range(levels + 1))


@query(_chain(6))
def mean_chain(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.mean_chain(cells(spark, d), 6).withColumn("h", F.col("h").cast("double"))


# --- views -----------------------------------------------------------------

_WAS = view.Camera((0.0, 50.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.5625, 0.0), (0.0, 0.0, -1.0), 10.0, 64, 36)
_NOW = view.Camera((1.5, 50.25, -2.0), (0.96, 0.0, 0.28), (0.0, 0.5625, 0.0), (0.28, 0.0, -0.96), 10.0, 64, 36)


def _frame(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_orderkey % 64 as px", "l_partkey % 36 as py", "l_suppkey % 200 as ox", "l_partkey % 250 as oy", "l_suppkey % 50 / 100.0D as depth", "l_partkey % 77 as material")
    return t.groupBy("px", "py").agg(F.max(F.struct("depth", "material", "ox", "oy")).alias("b")).select("px", "py", "b.ox", "b.oy", "b.depth", "b.material")


def _dot(v: tuple, x: str = "rx", y: str = "ry", z: str = "rz") -> str:
    return f"({x} * {v[0]}::double + {y} * {v[1]}::double + {z} * {v[2]}::double)"


def _size(v: tuple) -> str:
    return f"{v[0] * v[0] + v[1] * v[1] + v[2] * v[2]!r}::double"


def _ray(c: view.Camera, px: str, py: str, i: int) -> str:
    return f"({c.right[i]}::double * ({px} / {c.width} * 2 - 1) + {c.up[i]}::double * (1 - {py} / {c.height} * 2) + {c.forward[i]}::double)"


def _place(c: view.Camera, px: str, py: str, depth: str, i: int) -> str:
    return f"({c.eye[i]}::double + {_ray(c, px, py, i)} * ({c.near}::double / {depth}))"


_FRAME = """raw as (select l_orderkey % 64 as px, l_partkey % 36 as py, l_suppkey % 200 as ox, l_partkey % 250 as oy, l_suppkey % 50 / 100.0::double as depth, l_partkey % 77 as material from lineitem),
 frame as (select px, py, unnest(max({'depth': depth, 'material': material, 'ox': ox, 'oy': oy})) from raw group by 1, 2)"""


def _screen(c: view.Camera) -> str:
    """CTE over ``w`` (x, y, z, and whatever else): lx, ly, ahead."""
    return f"""rel as (select *, x - {c.eye[0]}::double as rx, y - {c.eye[1]}::double as ry, z - {c.eye[2]}::double as rz from w),
 ah as (select *, {_dot(c.forward)} / {_size(c.forward)} as ahead from rel),
 sc as (select *, case when ahead > 0 then ({_dot(c.right)} / {_size(c.right)} / ahead * 0.5 + 0.5) * {c.width} end as lx, case when ahead > 0 then (0.5 - {_dot(c.up)} / {_size(c.up)} / ahead * 0.5) * {c.height} end as ly from ah)"""


_LANDED = f"""with {_FRAME}, w as (select *, {", ".join(f"{_place(_WAS, '(px + ox / 256.0::double)', '(py + oy / 256.0::double)', 'depth', i)} as {a}" for i, a in enumerate("xyz"))} from frame where depth > 0),
 {_screen(_NOW)}, landed as (select floor(lx)::bigint as px, floor(ly)::bigint as py, floor((lx - floor(lx)) * 256)::int as ox, floor((ly - floor(ly)) * 256)::int as oy, {_NOW.near}::double / ahead as depth, material from sc where lx >= 0 and lx < 64 and ly >= 0 and ly < 36),
 carried as (select px, py, unnest(max({{'depth': depth, 'material': material, 'ox': ox, 'oy': oy}})) from landed group by 1, 2)"""


@query(_LANDED + " select px, py, round(depth, 9) as depth, material, ox, oy from carried")
def carry_frame(spark: SparkSession, d: str) -> DataFrame:
    return view.carry(_frame(spark, d), _WAS, _NOW).withColumn("depth", F.round("depth", 9))


_RANK = " + ".join(f"((((px >> {k}) & 1) + ((py >> {k}) & 1)) % 2 * 2 + ((py >> {k}) & 1)) * {4 ** (2 - k)}" for k in range(3))


@query(_LANDED + f", kept as (select px, py from carried where ({_RANK} + 5 * 19) % 64 >= 19) select i % 64 as px, i // 64 as py from range({64 * 36}) r(i) where (i % 64, i // 64) not in (select (px, py) from kept)")
def march_work(spark: SparkSession, d: str) -> DataFrame:
    return view.work_list(view.carry(_frame(spark, d), _WAS, _NOW), 5, 64, 36)


@query(f"""with {_FRAME}, r as (select px, py, {", ".join(f"{_ray(_NOW, '(px + 0.5::double)', '(py + 0.5::double)', i)} as {a}" for i, a in enumerate(("rx", "ry", "rz")))}, depth, material from frame)
select px, py, round(rx / sqrt(rx * rx + ry * ry + rz * rz), 9) as dx, round(ry / sqrt(rx * rx + ry * ry + rz * rz), 9) as dy, round(rz / sqrt(rx * rx + ry * ry + rz * rz), 9) as dz,
 case when depth > 0 then round(10.0::double / depth, 9) end as distance from r""")
def pixel_ray(spark: SparkSession, d: str) -> DataFrame:
    dx, dy, dz = view.normalised(*_NOW.ray(F.col("px") + 0.5, F.col("py") + 0.5))
    return _frame(spark, d).select("px", "py", F.round(dx, 9).alias("dx"), F.round(dy, 9).alias("dy"), F.round(dz, 9).alias("dz"), F.round(_NOW.distance(F.when(F.col("depth") > 0, F.col("depth"))), 9).alias("distance"))


@query(f"""with {_FRAME}, w as (select *, {", ".join(f"{_place(_NOW, '(px + 0.5::double)', '(py + 0.5::double)', 'nullif(depth, 0)', i)} as {a}" for i, a in enumerate("xyz"))} from frame), {_screen(_WAS)}
select px, py, round(coalesce(px + 0.5::double - lx, 0), 7) + 0 as mx, round(coalesce(py + 0.5::double - ly, 0), 7) + 0 as my from sc""")
def pixel_motion(spark: SparkSession, d: str) -> DataFrame:
    mx, my = view.motion(F.col("px"), F.col("py"), F.col("depth"), _NOW, _WAS)
    return _frame(spark, d).select("px", "py", (F.round(mx, 7) + 0).alias("mx"), (F.round(my, 7) + 0).alias("my"))


@query("select l_orderkey, l_linenumber, (l_partkey % 65536) | ((l_suppkey % 256) << 16) | ((l_orderkey % 128) << 24) as word, l_partkey % 65536 as id, l_suppkey % 256 as ox, l_orderkey % 128 as oy from lineitem")
def packed_offsets(spark: SparkSession, d: str) -> DataFrame:
    word = colour.pack_offset(F.expr("l_partkey % 65536"), F.expr("l_suppkey % 256"), F.expr("l_orderkey % 128"))
    ident, ox, oy = colour.unpack_offset(F.col("word"))
    return table(spark, d, "lineitem").withColumn("word", word).select("l_orderkey", "l_linenumber", "word", ident.alias("id"), ox.alias("ox"), oy.alias("oy"))


# --- residency -------------------------------------------------------------

_SIZES = "select p_partkey, cast(p_size % 20 as int) as tiles, cast(1 + p_partkey * 97 % 120000 as int) as raster, cast(1 + p_partkey % 9 as int) as available from part"
_LEVELS = "least(greatest(ceil(log2(raster / greatest((({n}) // 2 - 1) * 512, 1)::double))::int, 0) + 1, available)"


def _fit() -> str:
    start = "least(greatest(tiles, 1), 16)"
    out = "1"
    for k in range(4, -1, -1):
        n = f"({start} // {1 << k})"
        out = f"case when {n} >= 1 and {n}::bigint * 512 * {n} * 512 * 10 * {_LEVELS.format(n=n)} <= 400000000 then greatest({n}, {out}) else {out} end"
    return out


@query(f"with s as ({_SIZES}), f as (select *, cast({_fit()} as int) as fit from s) select p_partkey, fit, {_LEVELS.format(n='fit')}::int as levels, (fit * 512)::bigint * fit * 512 * 10 * {_LEVELS.format(n='fit')} as bytes from f")
def residency_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size % 20 as int) as tiles", "cast(1 + p_partkey * 97 % 120000 as int) as raster", "cast(1 + p_partkey % 9 as int) as available")
    t = t.withColumn("fit", view.fitting_tiles(F.col("tiles"), 512, F.col("raster"), F.col("available"), 400_000_000))
    levels = view.levels_needed(F.col("raster"), view.reach_texels(F.col("fit"), 512), F.col("available"))
    return t.select("p_partkey", "fit", levels.cast("int").alias("levels"), view.texture_bytes(F.col("fit"), 512, levels).alias("bytes"))


@query("select o_orderkey, o_orderkey % 300 - 150 >= o_custkey % 280 - 140 - 4 and o_orderkey % 300 - 150 < o_custkey % 280 - 140 + 4 as resident, ((o_orderkey % 300 - 150) % 8 + 8) % 8 as slot from orders")
def resident_slots(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("o_orderkey % 300 - 150")
    return table(spark, d, "orders").select("o_orderkey", view.resident(t, F.expr("o_custkey % 280 - 140"), 8).alias("resident"), view.slot(t, 8).alias("slot"))


@query("""with v as (select l_orderkey, l_linenumber, cast(cast((l_extendedprice - 40000) / l_quantity as float) as double) as v from lineitem), s as (select *, pow(2.0::double, greatest(floor(log2(abs(v))), -14) - 10) as step from v)
select l_orderkey, l_linenumber, case when v = 0 then 0 when ceil(v / step) * step > 65504 then 'inf'::double when v <= -65520 then '-inf'::double else ceil(v / step) * step end + 0 as ceiling from s""")
def half_ceiling(spark: SparkSession, d: str) -> DataFrame:
    v = ((F.col("l_extendedprice") - 40000) / F.col("l_quantity")).cast("float").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (view.ceiling_half(v) + 0).alias("ceiling"))


# --- regions and painting --------------------------------------------------

#: Every third rectangle is a hole of the region before it.
_REGION = "ring - ring % 3 as region, ring % 3 % 2 as part, ring % 3 = 2 as hole"


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corners = rectangles(spark, d)
    return corners.select("ring").distinct().selectExpr("ring", "ring - ring % 3 as region", "ring % 3 % 2 as part", "ring % 3 = 2 as hole"), corners


_IN = "count(*) filter (not hole and {p}) > 0 and count(*) filter (hole and {p}) = 0"


@query(f"""with r as (select *, {_REGION} from ({RECTS})), s as (select s_suppkey, s_suppkey % 130 + 0.25 as px, s_nationkey * 3 + 0.5 as py from supplier),
 h as (select s_suppkey, region, part from s join r on px > cx and px < cx + w and py > cy and py < cy + t group by 1, 2, 3 having count(*) filter (hole) = 0) select distinct s_suppkey, region from h""")
def region_of_point(spark: SparkSession, d: str) -> DataFrame:
    rings, corners = _regions(spark, d)
    p = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 130 + 0.25D as px", "s_nationkey * 3 + 0.5D as py")
    return regions.containing(p, rings, vector.ring_edges(corners), 2.0, ("s_suppkey",))


@query(f"""with recursive r as (select *, {_REGION} from ({RECTS})), b as (select s_suppkey as box, s_suppkey % 90 + 0.25::double as x, s_nationkey * 2 + 0.5::double as y from supplier),
 p as (select box, k, x + 8 * (k % 5) / 4.0::double as px, y + 2 * (k // 5) / 4.0::double as py from b, range(25) g(k)),
 h as (select box, k, region, part from p join r on px >= cx and px < cx + w and py >= cy and py < cy + t group by 1, 2, 3, 4 having count(*) filter (hole) = 0),
 a as (select box, region from (select distinct box, k, region from h) group by 1, 2 having count(*) = 25),
 f as (select region, (max(cx + w) - min(cx)) * (max(cy + t) - min(cy)) as footprint from r where not hole group by 1),
 d(region, depth) as (select 0, 0 union all select n.region, depth + 1 from d join (select distinct region from r where region > 0) n on n.region // 15 * 3 = d.region),
 w as (select box, region, row_number() over (partition by box order by depth desc, footprint, region) as k from a join f using (region) join d using (region))
select box, region from w where k = 1""")
def region_of_box(spark: SparkSession, d: str) -> DataFrame:
    """Regions form a tree, five children each; of those that hold a box the deepest is taken."""
    rings, corners = _regions(spark, d)
    b = table(spark, d, "supplier").selectExpr("s_suppkey as box", "s_suppkey % 90 + 0.25D as west", "s_nationkey * 2 + 0.5D as south", "s_suppkey % 90 + 8.25D as east", "s_nationkey * 2 + 2.5D as north")
    tree = rings.select("region").distinct().selectExpr("region", "if(region = 0, null, region div 15 * 3) as parent")
    return regions.deepest(b, rings, corners, vector.ring_edges(corners), tree, 2.0)


@query(f"""with r as ({RECTS}), c as (select cx + a as x, cy + b as y, ring as id, ring % 6 as layer, w * t as area, ring as index from r, range(60) p(a), range(10) q(b) where a < w and b < t),
 l as (select distinct s_suppkey % 100 + k as x, s_nationkey * 3 + k as y, -s_suppkey as id, 3.5 as layer, 0 as area, s_suppkey as index from supplier, range(12) g(k)),
 u as (select * from c union all select * from l) select x, y, arg_max(id, {{'layer': layer::double, 'area': -area::double, 'index': index}}) as id from u group by 1, 2""")
def paint_with_strokes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 100 as cx", "p_partkey % 71 as cy", "p_size as w", "p_size % 9 + 1 as t")
    at = lambda n, k: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(k)
    areas = r.where("w > 0").select("*", at("w", "a")).select("*", at("t", "b")).selectExpr("cx + a as x", "cy + b as y", "id", "id % 6 as layer", "w * t as area", "id as index")
    lines = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).selectExpr("s_suppkey % 100 + k as x", "s_nationkey * 3 + k as y", "-s_suppkey as id", "s_suppkey as index")
    return vector.paint_all(areas, lines)


@query("select s_suppkey as node, s_acctbal as x from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 45)")
def wanted_nodes(spark: SparkSession, d: str) -> DataFrame:
    ways = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("refs"))
    return vector.wanted(table(spark, d, "supplier").selectExpr("s_suppkey as node", "s_acctbal as x"), ways)


# --- files -----------------------------------------------------------------


@query(f"with {CELLS} select x - 20 as x, y - 40 as y, round(h / 1000.0::double, 0)::float::double as h from cells where round(h / 1000.0::double, 0) >= 1000")
def geotiff_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Cells as files of 32 texels a side, on both sides of the origin, read back; texels under a bound are left out."""
    c = cells(spark, d).select((F.col("x") - 20).alias("x"), (F.col("y") - 40).alias("y"), F.round(F.col("h") / 1000.0, 0).alias("h"))
    files = geotiff.tile_files(c, 32, 3979, 2.0, nodata.HEIGHT_NODATA)
    return geotiff.read_cells(files, 1000.0).withColumn("h", F.col("h").cast("double"))


@query(f"with {CELLS}, t as (select floor((x - 20) / 32.0)::int as tx, floor((y - 40) / 32.0)::int as ty, count(*) as n from cells group by 1, 2) select tx, ty, tx * 64.0::double as west, ty * -64.0::double as north, n from t")
def geotiff_places(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select((F.col("x") - 20).alias("x"), (F.col("y") - 40).alias("y"), "h")
    files = geotiff.tile_files(c, 32, 3979, 2.0, nodata.HEIGHT_NODATA)
    return geotiff.places(files).select("tx", "ty", "west", "north", "n")
