"""Queries over the embedded tables: detail on coarse landscapes, cover, warped fills, cameras, files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera, cover, crs, ground
from ..functions.materials import ID
from ..operators import fields, fill
from ..sources import files
from .embeddings import CELLS, cells, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- cover -----------------------------------------------------------------

_VALLEY, _PEAK = 200.0, 2200.0
#: Each input of the rules from another column, so that every rule is met.
_PLACE = {
    "h": "200 + (l_partkey * 7 + l_orderkey) % 2000", "filled": "201 + (l_partkey * 7 + l_orderkey) % 2000", "slope": "l_suppkey * 13 % 50 / 50.0D", "south": "l_linenumber / 4.0D - 1", "flow": "8 + l_orderkey * 3 % 80 / 10.0D",
    "hard": "l_partkey % 11 / 10.0D", "wobble": "l_orderkey % 21 / 10.0D - 1", "mottle": "l_suppkey * 17 % 41 / 20.0D - 1", "depth": "greatest(l_orderkey * 11 % 97 / 10.0D - 6.5D, 0.0D)", "deposit": "l_partkey * 5 % 37 / 6.0D",
}
_PLACE_SQL = ", ".join(f"({e.replace('0D', '0::double').replace('5D', '5::double')}) as {k}" for k, e in _PLACE.items())
_SMOOTH = lambda a, b, v: f"(least(greatest(({v} - {a}) / ({b} - {a}), 0), 1) * least(greatest(({v} - {a}) / ({b} - {a}), 0), 1) * (3 - 2 * least(greatest(({v} - {a}) / ({b} - {a}), 0), 1)))".replace("  ", " ")
_GROUND_SQL = f"""raw as (select l_orderkey, l_linenumber, {_PLACE_SQL} from lineitem),
 g0 as (select *, {_SMOOTH('0.25::double', '0.9::double', 'slope')} as steep, {_SMOOTH('0.4::double', '2.5::double', 'depth')} as lake, {_SMOOTH('0::double', '6::double', 'deposit')} as filling, {_SMOOTH('11.5::double', '15.5::double', 'flow')} as run from raw),
 g as (select *, steep * (0.35::double + 0.65::double * hard) as rocky, run * (1 - lake) * {_SMOOTH('0.5::double', '1.5::double', '1.25::double')} as channel from g0)"""


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e).cast("double").alias(k) for k, e in _PLACE.items()))
    parts = ground.fractions(F.col("slope"), F.col("depth"), F.col("flow"), F.col("hard"), F.col("deposit"), 16.0, 16.0)
    return t.select("*", *(v.alias(k) for k, v in parts.items())), {k: F.col(k) for k in parts}


def _cover_sql() -> str:
    trees, snow = (f"(200 + 2000 * ({share}::double + wobble * {w}::double + south * steep * {s!r}::double))" for share, w, s in ((0.52, 0.05, 0.063), (0.76, 0.03, 0.063 * 1.2)))
    rules = [
        ("Lake", "lake > 0.5"), ("River", "channel > 0.62"), ("Stream", "channel > 0.28"), ("Bog", "wet and h > trees"), ("Marsh", "wet"),
        ("Glacier", "h > snow + mottle * 100 and steep < 0.45"),
        ("BareRock", f"rocky > 0.86::double - 0.44::double * {_SMOOTH('(trees - 158)', '(trees + 158)', 'h')} + mottle * 0.1::double"),
        ("Scree", "steep > 0.3 and filling > 0.22"),
        ("Fell", f"h > trees and {_SMOOTH('trees', 'snow', '(h + mottle * 100)')} > 0.55"), ("Heath", "h > trees and (steep > 0.25 or hard > 0.6)"), ("Grassland", "h > trees"),
        ("Shingle", "flat and channel > 0.04 and filling > 0.45"), ("Sand", "flat and filling > 0.7 and mottle > 0.45"), ("Meadow", "flat and mottle > 0.15"), ("Grassland", "flat"),
        ("Scrub", f"{_SMOOTH('(trees - 274)', 'trees', '(h + mottle * 75)')} > 0.6"),
        ("ForestBroadleaved", "low and flow > 8 and steep < 0.3"), ("ForestMixed", "low and (south > 0.25 or mottle > 0.25)"),
    ]
    when = " ".join(f"when {c} then {ID[n]}" for n, c in rules)
    return f"""with {_GROUND_SQL}, l as (select *, {trees} as trees, {snow} as snow, lake > 0.12 or (slope < 0.035 and flow > 9 and filling > 0.25) as wet,
 slope < 0.09 and least(greatest((h - 200) / 2000.0::double, 0), 1) < 0.35 as flat, (h - 200) / 2000.0::double < 0.3::double + mottle * 0.08::double as low from g)
select l_orderkey, l_linenumber, cast(case {when} else {ID["ForestNeedleleaved"]} end as int) as id from l"""


@query(_cover_sql())
def ground_cover(spark: SparkSession, d: str) -> DataFrame:
    t, g = _places(spark, d)
    p = cover.Place(*(F.col(k) for k in ("h", "slope", "south", "flow", "hard", "wobble", "mottle")))
    return t.select("l_orderkey", "l_linenumber", cover.material(p, g, _VALLEY, _PEAK).cast("int").alias("id"))


@query(f"""with {_GROUND_SQL}, land as (select *, h + wobble * 5 * (0.25::double + 1.5::double * steep) * (1 - 0.7::double * filling) + (mottle / 2) * 15 * rocky * (1 - filling) + (wobble / 2) * 6 * filling * (1 - steep) - channel * 4 as land from g)
select l_orderkey, l_linenumber, round(land * (1 - lake) + filled * lake, 6) as h from land""")
def detail_height(spark: SparkSession, d: str) -> DataFrame:
    t, g = _places(spark, d)
    h = cover.detail_height(F.col("h"), F.col("filled"), g, F.col("wobble"), F.col("mottle") / 2, F.col("wobble") / 2)
    return t.select("l_orderkey", "l_linenumber", F.round(h, 6).alias("h"))


@query()
def cover_of_noise(spark: SparkSession, d: str) -> DataFrame:
    """Detail and cover with noise of the lattice, over every line as a texel of 4 m."""
    t, g = _places(spark, d)
    x, y = (F.col("l_orderkey") * 4).cast("double"), (F.col("l_linenumber") * 4).cast("double")
    t = t.select("*", *(v.alias(k) for k, v in zip(("wob", "mot"), cover.unevenness(x, y, 4.0, 7), strict=True)))
    t = t.select("*", *(v.alias(k) for k, v in zip(("texture", "ribs", "moraine"), cover.reliefs(x, y, 4.0, 7), strict=True)))
    p = cover.Place(*(F.col(k) for k in ("h", "slope", "south", "flow", "hard", "wob", "mot")))
    h = cover.detail_height(F.col("h"), F.col("filled"), g, F.col("texture"), F.col("ribs"), F.col("moraine"))
    return t.select("l_orderkey", "l_linenumber", F.round(h, 4).alias("h"), cover.material(p, g, _VALLEY, _PEAK).cast("int").alias("id"))


# --- fields and warps ------------------------------------------------------

_DENSE = f"{CELLS}, dense as (select i % 64 as x, i // 64 as y, coalesce(h, 0) / 100000.0::double as h, (i * 37 % 101) / 101.0::double as hard from range(4096) r(i) left join cells on x = i % 64 and y = i // 64)"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    all_cells = fill.grid(spark, 0, 0, 64, 64).join(cells(spark, d), ["x", "y"], "left")
    return all_cells.select("x", "y", (F.coalesce("h", F.lit(0)) / 100000.0).alias("h"), ((F.col("y") * 64 + F.col("x")) * 37 % 101 / 101.0).alias("hard"))


def _cubic(f: str) -> str:
    return f"(-{f} * {f} * {f} + 2 * {f} * {f} - {f}) / 2", f"(3 * {f} * {f} * {f} - 5 * {f} * {f} + 2) / 2", f"(-3 * {f} * {f} * {f} + 4 * {f} * {f} + {f}) / 2", f"({f} * {f} * {f} - {f} * {f}) / 2"


_CUBIC = lambda k, f: f"case {k} " + " ".join(f"when {n} then {w}" for n, w in enumerate(_cubic(f))) + " end"


@query(f"""with {_DENSE}, p as (select o_orderkey, o_custkey % 630 / 10.0::double as px, o_orderkey % 631 / 10.0::double as py from orders),
 q as (select *, px + dx as qx, py + dy as qy from p, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
 t as (select *, qx - floor(qx) as fx, qy - floor(qy) as fy, least(greatest(floor(qx) + i - 1, 0), 63)::bigint as x, least(greatest(floor(qy) + j - 1, 0), 63)::bigint as y from q, range(4) a(i), range(4) b(j)),
 w as (select o_orderkey, dx, dy, x, y, ({_CUBIC('i', 'fx')}) * ({_CUBIC('j', 'fy')}) as w from t),
 s as (select o_orderkey, dx, dy, sum(w * h) as v, sum(w * hard) as u from w join dense using (x, y) group by 1, 2, 3),
 f as (select o_orderkey, max(v) filter (dx = 0 and dy = 0) as h, max(u) filter (dx = 0 and dy = 0) as hard, (max(v) filter (dx = -1) - max(v) filter (dx = 1)) / 32 as we, (max(v) filter (dy = -1) - max(v) filter (dy = 1)) / 32 as ws from s group by 1)
select o_orderkey, round(h, 6) + 0 as h, round(hard, 6) + 0 as hard, round(sqrt(we * we + ws * ws), 6) + 0 as slope, case when sqrt(we * we + ws * ws) > 1e-6 then round(we / sqrt(we * we + ws * ws), 5) + 0 else 0 end as east from f""")
def field_sample(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 630 / 10.0D * 16 as x", "o_orderkey % 631 / 10.0D * 16 as y")
    s = fields.sample(p, _dense(spark, d), ("o_orderkey",), (64, 64), 16.0, ("h", "hard"))
    return s.select("o_orderkey", *((F.round(c, n) + 0).alias(c) for c, n in (("h", 6), ("hard", 6), ("slope", 6), ("east", 5))))


#: A target of 48 x 48 texels of Mercator metres over two sources in degrees, a fine one with holes over a coarse one.
_TARGET, _FINE, _COARSE = fields.Lattice(-8_000_000.0, 6_000_000.0, 2000.0), fields.Lattice(-72.0, 47.4, 0.01), fields.Lattice(-73.0, 48.0, 0.05)


def _read_sql(cte: str, at: fields.Lattice, tier: int) -> str:
    return f"""t{tier} as (select tx, ty, (lon - ({at.west!r}::double)) / {at.metres!r}::double - 0.5::double as px, ({at.north!r}::double - lat) / {at.metres!r}::double - 0.5::double as py from holes),
 r{tier} as (select tx, ty, sum(h * (case when a = 1 then px - floor(px) else 1 - px + floor(px) end) * (case when b = 1 then py - floor(py) else 1 - py + floor(py) end)) as h, {tier} as tier
  from t{tier}, range(2) i(a), range(2) j(b) join {cte} s on s.x = floor(px)::bigint + a and s.y = floor(py)::bigint + b group by 1, 2 having count(*) = 4)"""


@query(f"""with {_DENSE}, fine as (select x, y, h from dense where h > 0.2), holes as (select i % 48 as tx, i // 48 as ty, degrees((-8000000 + (i % 48 + 0.5::double) * 2000) / {crs.A}::double) as lon, degrees(2 * atan(exp((6000000 - (i // 48 + 0.5::double) * 2000) / {crs.A}::double)) - pi() / 2) as lat from range(2304) r(i)),
 {_read_sql('fine', _FINE, 1)}, {_read_sql('dense', _COARSE, 2)}, u as (select * from r1 union all select * from r2 where (tx, ty) not in (select (tx, ty) from r1))
select tx as x, ty as y, round(h, 5) as h, tier::int as tier from u""")
def warp_fill(spark: SparkSession, d: str) -> DataFrame:
    dense = _dense(spark, d).select("x", "y", "h")
    sources = [(dense.where("h > 0.2"), _FINE, crs.mercator_inverse), (dense, _COARSE, crs.mercator_inverse)]
    return fields.fill_in_turn(fill.grid(spark, 0, 0, 48, 48), _TARGET, sources).select("x", "y", F.round("h", 5).alias("h"), "tier")


# --- cameras ---------------------------------------------------------------

_HEADING = "select o_orderkey, o_orderkey % 62 / 10.0::double - 3.05::double as yaw, o_custkey % 31 / 10.0::double - 1.5::double as pitch, o_orderkey * 7 % 60 / 10.0::double - 2.95::double as roll, 1 + o_custkey % 5 / 4.0::double as aspect from orders"
_TAN = f"{math.tan(math.radians(30.0))!r}::double"


def _headings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 62 / 10.0D - 3.05D as yaw", "o_custkey % 31 / 10.0D - 1.5D as pitch", "o_orderkey * 7 % 60 / 10.0D - 2.95D as roll", "1 + o_custkey % 5 / 4.0D as aspect")
    return t.withColumn("q", camera.quaternion(F.col("yaw"), F.col("pitch"), F.col("roll")))


@query(f"with a as ({_HEADING}) select o_orderkey, round(yaw, 7) + 0 as yaw, round(pitch, 7) + 0 as pitch, round(roll, 7) + 0 as roll from a")
def heading_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = _headings(spark, d)
    return t.select("o_orderkey", *((F.round(v, 7) + 0).alias(k) for k, v in zip(("yaw", "pitch", "roll"), camera.angles(F.col("q")), strict=True)))


_RIGHT = ("cos(yaw) * cos(roll) + sin(yaw) * sin(pitch) * sin(roll)", "-cos(pitch) * sin(roll)", "sin(yaw) * cos(roll) - cos(yaw) * sin(pitch) * sin(roll)")
_UP = ("cos(yaw) * sin(roll) - sin(yaw) * sin(pitch) * cos(roll)", "cos(pitch) * cos(roll)", "sin(yaw) * sin(roll) + cos(yaw) * sin(pitch) * cos(roll)")
_AHEAD = ("sin(yaw) * cos(pitch)", "sin(pitch)", "-cos(yaw) * cos(pitch)")


@query(f"with a as ({_HEADING}) select o_orderkey, " + ", ".join(f"round(({e}){s}, 7) + 0 as {n}{c}" for n, v, s in (("r", _RIGHT, f" * {_TAN} * aspect"), ("u", _UP, f" * {_TAN}"), ("f", _AHEAD, "")) for c, e in zip("xyz", v, strict=True)) + " from a")
def screen_basis(spark: SparkSession, d: str) -> DataFrame:
    basis = camera.ray_basis(F.col("q"), F.col("aspect"))
    return _headings(spark, d).select("o_orderkey", *((F.round(e, 7) + 0).alias(n + c) for n, v in zip("ruf", basis, strict=True) for c, e in zip("xyz", v, strict=True)))


_AWAY = " + ".join("({}) * {}".format(e, v) for e, v in zip(_AHEAD, ("30", "-20", "-400"), strict=True))


@query(f"""with a as ({_HEADING}), s as (select o_orderkey, aspect, {' + '.join(f'({e}) * {v}' for e, v in zip(_RIGHT, (30, -20, -400), strict=True))} as x, {' + '.join(f'({e}) * {v}' for e, v in zip(_UP, (30, -20, -400), strict=True))} as y, {_AWAY} as away from a)
select o_orderkey, round(x / {_TAN} / aspect, 6) + 0 as cx, round(y / {_TAN}, 6) + 0 as cy, 1.0::double as cz, round(away, 6) + 0 as cw from s""")
def clip_place(spark: SparkSession, d: str) -> DataFrame:
    eye, point = ((F.lit(a), F.lit(b), F.lit(c)) for a, b, c in ((5.0, 120.0, 60.0), (35.0, 100.0, -340.0)))
    clip = camera.to_clip(camera.to_view(F.col("q"), eye, point), F.col("aspect"))
    return _headings(spark, d).select("o_orderkey", *((F.round(v, 6) + 0).alias(k) for k, v in zip(("cx", "cy", "cz", "cw"), clip, strict=True)))


@query("""with e as (select p_partkey, 1000.0::double + p_partkey % 977 * 10 as w, 500.0::double + p_partkey * 3 % 1013 * 10 as h, p_retailprice::double as top from part)
select p_partkey, round(top + 0.08::double * greatest(w, h), 6) as eye_up, h / 2 as eye_south, round(-atan((top + 0.08::double * greatest(w, h)) / h), 9) as pitch from e""")
def overlooking_view(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "1000.0D + p_partkey % 977 * 10 as w", "500.0D + p_partkey * 3 % 1013 * 10 as h", "cast(p_retailprice as double) as top")
    (_, up, south), pitch = camera.overlooking(F.col("w"), F.col("h"), F.col("top"))
    return t.select("p_partkey", F.round(up, 6).alias("eye_up"), south.alias("eye_south"), F.round(pitch, 9).alias("pitch"))


# --- files -----------------------------------------------------------------


@query("select o_orderkey, case when o_orderkey % 5 <> 0 then md5(o_orderkey::varchar) end as md5 from orders")
def published_digest(spark: SparkSession, d: str) -> DataFrame:
    """Checksum files made from the keys, read back; every fifth is no checksum file."""
    digest = F.upper(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("not found "), digest)).otherwise(F.concat(digest, F.lit("  extract.pbf\n")))
    return table(spark, d, "orders").select("o_orderkey", files.published_md5(text).alias("md5"))


@query()
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.listing(spark, d, "*.parquet").select("path", "length")


@query()
def png_images(spark: SparkSession, d: str) -> DataFrame:
    """The embedded cells in shades of grey as images of 32 pixels a side; holes are transparent."""
    grey = (F.col("h") % 256).cast("int")
    pixels = cells(spark, d).select("x", "y", grey.alias("r"), grey.alias("g"), grey.alias("b"), F.lit(255).alias("a"))
    return files.png_tiles(pixels, 32).select("tx", "ty", F.length("content").alias("bytes"), F.md5("content").alias("md5"))
