"""Detail, cover, fields, cameras and files, against small cases worked by hand."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import batch_noise, camera, cover, noise
from tessera.functions.materials import ID
from tessera.operators import fields
from tessera.sources import catalog, files


def test_batch_noise_equals_columns(spark):
    t = spark.range(40).selectExpr("id * 3.7 - 55 as x", "id % 7 * 11.3 - 31 as y").selectExpr("cast(x as double) as x", "cast(y as double) as y")
    f = noise.Fractal(24.0, 3)
    x, y = F.col("x"), F.col("y")
    for kind, plain in (("fbm", noise.fbm), ("billow", noise.billow), ("ridged", noise.ridged)):
        rows = t.select(plain(x, y, 9, f).alias("a"), batch_noise.column(kind, x, y, 9, f).alias("b")).collect()
        assert all(abs(r.a - r.b) < 1e-12 for r in rows)
    none = spark.sql("select cast(null as double) as x, 1.0D as y union all select double('nan'), 1.0D").select(batch_noise.column("fbm", x, y, 9, f).alias("v"))
    assert [r.v for r in none.collect()] == [None, None]


def _cover(spark, **given):
    place = dict(height=500.0, slope=0.2, south=0.0, flow=0.0, hardness=0.0, wobble=0.0, mottle=0.0)
    parts = dict(steepness=0.0, rockiness=0.0, filling=0.0, lake=0.0, channel=0.0)
    place |= {k: v for k, v in given.items() if k in place}
    parts |= {k: v for k, v in given.items() if k in parts}
    lit = lambda d: {k: F.lit(v).cast("double") for k, v in d.items()}
    return spark.range(1).select(cover.material(cover.Place(**lit(place)), lit(parts), 0.0, 1000.0).alias("m")).first().m


@pytest.mark.parametrize(
    "name, given",
    [
        ("Lake", dict(lake=0.6, channel=0.9)), ("River", dict(channel=0.7)), ("Stream", dict(channel=0.3)), ("Marsh", dict(lake=0.2)), ("Bog", dict(lake=0.2, height=700.0)),
        ("Glacier", dict(height=900.0)), ("BareRock", dict(height=900.0, steepness=0.5, rockiness=0.5)), ("Scree", dict(steepness=0.4, filling=0.3)), ("Heath", dict(height=600.0, hardness=0.7)),
        ("Grassland", dict(height=600.0)), ("Fell", dict(height=750.0)), ("Shingle", dict(height=100.0, slope=0.05, channel=0.1, filling=0.5)), ("Sand", dict(height=100.0, slope=0.05, filling=0.8, mottle=0.5)),
        ("Meadow", dict(height=100.0, slope=0.05, mottle=0.2)), ("Scrub", dict(height=515.0)), ("ForestBroadleaved", dict(height=100.0, flow=9.0)), ("ForestMixed", dict(height=100.0, south=0.5)),
        ("ForestNeedleleaved", dict(height=380.0)), ("ForestNeedleleaved", dict(height=None)),
    ],
)
def test_cover_rules(spark, name, given):
    assert _cover(spark, **given) == ID[name]


def test_cover_needs_relief(spark):
    with pytest.raises(ValueError):
        cover.material(cover.Place(*[F.lit(0.0)] * 7), {k: F.lit(0.0) for k in ("steepness", "rockiness", "filling", "lake", "channel")}, 5.0, 5.0)


def test_lake_is_level(spark):
    g = {k: F.lit(v) for k, v in dict(steepness=0.5, rockiness=0.5, filling=0.5, channel=0.0, lake=1.0).items()}
    h = cover.detail_height(F.lit(10.0), F.lit(12.5), g, F.lit(1.0), F.lit(0.5), F.lit(0.5))
    assert spark.range(1).select(h.alias("h")).first().h == 12.5


def test_field_of_a_plane(spark):
    """On a plane the samples, the slope and the fall are exact away from the border; nulls and missing cells give no row."""
    cells = spark.range(144).selectExpr("id % 12 as x", "id div 12 as y", "cast(3 * (id % 12) + 4 * (id div 12) as double) as h", "1 as extra")
    points = spark.createDataFrame([(1, 50.0, 62.0, 7), (2, 41.0, 44.0, 8), (3, None, 4.0, 9)], "k long, x double, y double, h long")
    rows = {r.k: r for r in fields.sample(points, cells, ("k",), (12, 12), 10.0, ("h",)).collect()}
    assert set(rows) == {1, 2}
    assert abs(rows[1].h - (15 + 24.8)) < 1e-9 and abs(rows[1].slope - 0.5) < 1e-9
    assert abs(rows[1].east + 0.6) < 1e-9 and abs(rows[1].south + 0.8) < 1e-9
    holed = cells.where("not (x = 5 and y = 6)")
    assert fields.sample(points, holed, ("k",), (12, 12), 10.0, ("h",)).count() == 0
    assert fields.sample(points.limit(0), cells, ("k",), (12, 12), 10.0, ("h",)).count() == 0
    flat = cells.withColumn("h", F.lit(2.0))
    r = fields.sample(points, flat, ("k",), (12, 12), 10.0, ("h",)).first()
    assert abs(r.slope) < 1e-12 and (r.east, r.south) == (0.0, 0.0)  # the weights sum to nothing but for rounding


def test_fill_in_turn(spark):
    """The first source that has all four corners counts; a hole that none reaches has no row."""
    plane = spark.range(64).selectExpr("id % 8 as x", "id div 8 as y", "cast(id % 8 as double) as h")
    holes = spark.createDataFrame([(0, 0), (3, 3), (20, 20)], "x long, y long")
    target, same = fields.Lattice(100.0, 200.0, 1.0), fields.Lattice(98.5, 201.5, 1.0)
    first = plane.where("x < 4")
    got = fields.fill_in_turn(holes, target, [(first, same, None), (plane, same, lambda e, n: (e, n))])
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1.5, 1), (3, 3, 4.5, 2)]


@pytest.mark.parametrize("yaw, pitch, roll", [(0.3, 0.2, -0.4), (-3.0, -1.2, 2.0), (0.0, 0.0, 0.0), (0.7, math.pi / 2, 0.0), (0.7, -math.pi / 2, 0.0)])
def test_headings(spark, yaw, pitch, roll):
    q = camera.quaternion(F.lit(yaw), F.lit(pitch), F.lit(roll))
    r = spark.range(1).select(*(v.alias(n) for n, v in zip("ypr", camera.angles(q)))).first()
    assert max(abs(a - b) for a, b in zip(r, (yaw, pitch, roll))) < 1e-6


def test_overlooking_sees_the_far_edge(spark):
    (_, up, south), pitch = camera.overlooking(F.lit(1000.0), F.lit(4000.0), F.lit(300.0))
    r = spark.range(1).select(up.alias("u"), south.alias("s"), pitch.alias("p")).first()
    assert r.u == 620.0 and r.s == 2000.0
    assert abs(r.u + math.tan(r.p) * 4000.0) < 1e-9
    near = spark.range(1).select(*(v.alias(n) for n, v in zip("xyzw", camera.to_clip((F.lit(0.0), F.lit(0.0), F.lit(-1.0)), F.lit(1.5))))).first()
    assert near.z / near.w == 1.0


def _rows_of(png: bytes) -> tuple[int, int, bytes]:
    at, body, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + data)
        size = struct.unpack(">II", data[:8]) if kind == b"IHDR" else size
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    raw, (w, h) = zlib.decompress(body), size
    return w, h, b"".join(raw[k * (w * 4 + 1) + 1 : (k + 1) * (w * 4 + 1)] for k in range(h))


def test_png_tiles(spark):
    t = spark.createDataFrame([(0, 0, 9, 8, 7, 255), (-1, 1, 1, 2, 3, 4), (0, 0, 1, 1, 1, 1), (3, 3, None, 5, 6, 7), (None, 1, 1, 1, 1, 1)], "x long, y long, r int, g int, b int, a int")
    got = {(r.tx, r.ty): _rows_of(bytes(r.content)) for r in files.png_tiles(t, 4).collect()}
    assert set(got) == {(0, 0), (-1, 0)}
    w, h, raw = got[0, 0]
    assert (w, h) == (4, 4) and raw[:4] == bytes([9, 8, 7, 255]) and raw[-4:] == bytes([0, 5, 6, 7]) and raw[4:-4] == bytes(56)
    assert got[-1, 0][2][28:32] == bytes([1, 2, 3, 4])
    assert files.png_tiles(t.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        files.png(2, 2, b"")


def test_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for root, name, text in ((a, "x.bin", b"one"), (a, "in/y.bin", b"three"), (b, "x.bin", b"one"), (b, "in/y.bin", b"thr"), (a, "z.txt", b""), (a, "a b+%.txt", b"four")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    here, there = files.listing(spark, str(a), "*.bin"), files.listing(spark, str(b), "*.bin")
    assert sorted((r.path, r.length) for r in here.collect()) == [("in/y.bin", 5), ("x.bin", 3)]
    assert [r.path for r in files.lacking(here, there).collect()] == ["in/y.bin"]
    assert sorted(r.path for r in files.listing(spark, str(a)).collect()) == ["a b+%.txt", "in/y.bin", "x.bin", "z.txt"]
    assert {r.length: r.md5 for r in files.digests(spark, str(a)).collect()}[0] == "d41d8cd98f00b204e9800998ecf8427e"
    text = spark.createDataFrame([("D41D8CD98F00B204E9800998ECF8427E  x\n",), ("nothing",), (None,)], "t string").select(files.published_md5(F.col("t")).alias("m"))
    assert [r.m for r in text.collect()] == ["d41d8cd98f00b204e9800998ecf8427e", None, None]


def test_discover(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 1, 5.0)], "level int, x int, y int, value double")
    m = dict(version=1, epsg=3979, tile_size=512, base_level=0, level_count=1, base_metres_per_texel=1.0, origin_metres=[0.0, 0.0], extent_texels=[512, 512], bands=1, nodata=-1.0)
    for name in ("snow", "rock"):
        catalog.write_product(cells, str(tmp_path), {**m, "product": name})
    assert [r.product for r in files.discover(spark, str(tmp_path)).collect()] == ["rock", "snow"]
    assert [r.product for r in files.discover(spark, str(tmp_path), ("snow",)).collect()] == ["snow"]
