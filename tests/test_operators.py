"""Kernels and helpers against plain definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import crs, grid, materials, noise, text
from tessera.operators import rays, terrain, tiles, vector
from tessera.plans import queries
from tessera.sources import catalog
from tessera.streaming import track
from tests import naive

RNG = np.random.default_rng(9)


def test_projection_control_points(spark):
    rows = [(-123.1, 49.7, -1956653.44, 517123.37), (-123.3054, 49.63473, -1973119.85, 516927.57), (-95.0, 49.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, wx double, wy double")
    x, y = crs.lambert(F.col("lon"), F.col("lat"))
    lon, lat = crs.lambert_inverse(F.col("x"), F.col("y"))
    for r in df.withColumn("x", x).withColumn("y", y).withColumn("blon", lon).withColumn("blat", lat).collect():
        assert abs(r.x - r.wx) < 0.01 and abs(r.y - r.wy) < 0.01 and abs(r.blon - r.lon) < 1e-9 and abs(r.blat - r.lat) < 1e-9
    x, y = crs.mercator(F.lit(-123.305), F.lit(49.635))
    r = df.limit(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x + 13726249.8123) < 0.01 and abs(r.y - 6383302.5910) < 0.01


def test_noise_matches_definition(spark):
    f = noise.Fractal(10.0, 3)
    pts = [(float(a), float(b)) for a, b in RNG.uniform(-50, 50, (20, 2))]
    df = spark.createDataFrame(pts, "x double, y double")

    def mix(b):
        b = (b ^ b >> 16) * 0x7FEB352D & 0xFFFFFFFF
        b = (b ^ b >> 15) * 0x846CA68B & 0xFFFFFFFF
        return b ^ b >> 16

    def word(x, y, s):
        return mix(mix((s * noise.SEED & 0xFFFFFFFF) ^ (x * noise.X & 0xFFFFFFFF)) ^ (y * noise.Y & 0xFFFFFFFF))

    def gradient(x, y, s):
        ix, iy = math.floor(x), math.floor(y)
        fx, fy = x - ix, y - iy
        fade = lambda t: t**3 * (t * (t * 6 - 15) + 10)
        c = {}
        for i in (0, 1):
            for j in (0, 1):
                a = word(ix + i, iy + j, s) % 16 * math.pi / 8
                c[i, j] = math.cos(a) * (fx - i) + math.sin(a) * (fy - j)
        low = c[0, 0] + (c[1, 0] - c[0, 0]) * fade(fx)
        high = c[0, 1] + (c[1, 1] - c[0, 1]) * fade(fx)
        return (low + (high - low) * fade(fy)) * math.sqrt(2)

    got = df.select("x", "y", noise.fbm(F.col("x"), F.col("y"), 3, f).alias("v")).collect()
    for r in got:
        want = sum(gradient(r.x * q, r.y * q, 3 ^ (k * 0x51ED270B & 0xFFFFFFFF)) * 0.5**k for k, q in enumerate(f.frequencies)) / 1.75
        assert math.isclose(r.v, want, abs_tol=1e-9)


def test_bayer_covers_every_rank(spark):
    r = spark.range(64).select(noise.bayer_rank(F.col("id") % 8, F.floor(F.col("id") / 8)).alias("r")).collect()
    assert sorted(x.r for x in r) == list(range(64))


def test_material_vocabulary():
    assert len(materials.ID) == 77 and materials.ID["WaterUnknown"] == 0x01FF and materials.ID["Building"] == 0x070F
    assert materials.PRECEDENCE["Lake"] == 5 and materials.PRECEDENCE["Ocean"] == 0 and materials.PRECEDENCE["Clearcut"] == 2 and materials.PRECEDENCE["FlowerBed"] == 3
    assert all(p is not None for p in materials.PRECEDENCE.values())


@pytest.mark.parametrize("parts,want", [([[1, 2, 3], [5, 4, 3], [5, 6, 1]], [7]), ([[1, 2, 3], [4, 5, 1]], [5]), ([[2, 3], [1, 2]], [3]), ([[1, 2, 3, 1], [7, 8, 9, 7]], [4, 4])])
def test_stitching(parts, want):
    assert [len(c) for c in vector.stitch(parts)] == want


def test_flood_and_accumulation():
    h = RNG.uniform(0, 10, (20, 24))
    filled, to, order = terrain.flood(h)
    low = np.where(np.pad(np.zeros((18, 22), bool), 1, constant_values=True), h, np.inf)
    while True:  # monotone relaxation
        p = np.pad(low, 1, constant_values=np.inf)
        near = np.min([p[1 + dy : 21 + dy, 1 + dx : 25 + dx] for dx, dy in terrain.NEIGHBOURS], 0)
        new = np.minimum(low, np.maximum(h, near))
        if (new == low).all():
            break
        low = new
    assert np.allclose(filled, low) and len(order) == h.size
    area = terrain.accumulate(filled, to, order)
    leaves = [(r, c) for r in range(20) for c in range(24) if to[r, c] < 0 and not any(filled[i, j] < filled[r, c] for _, _, i, j in terrain._around(h.shape, r, c))]
    assert math.isclose(sum(area[p] for p in leaves), h.size)
    assert (terrain.incise(h, 2, 0.05) <= h + 1e-12).all()
    assert math.isclose(terrain.droplets(h, 100).sum(), h.sum())


def test_erosion_covers_its_grids(spark):
    sf = "/root/testdata/sf0.001"
    c = queries.cells(spark, sf).toPandas()
    c = c[(c["x"] < 32) & (c["y"] < 32)]
    h = np.full((32, 32), float(c["h"].min()))
    h[c["y"], c["x"]] = c["h"]
    for q, column, want in ((queries.droplet_erosion, "h", terrain.droplets(h, 3 * 32 * 32)), (queries.incision, "bed", terrain.incise(h, 80 + 12, 0.01))):
        got = q(spark, sf).where("grid = 0").toPandas()
        assert len(got) == h.size and np.allclose(got.sort_values(["y", "x"])[column], want.ravel())


def test_nearest_ids():
    ids = np.where(RNG.random((15, 18)) < 0.1, RNG.integers(1, 9, (15, 18)), 0)
    out = naive.nearest_ids(ids, ids > 0, 30)
    seeds = np.argwhere(ids)
    for r in range(15):
        for c in range(18):
            d = {(i, j): 3 * max(abs(i - r), abs(j - c)) + min(abs(i - r), abs(j - c)) for i, j in seeds}
            best = min(d.values())
            assert out[r, c] in ({ids[p] for p, v in d.items() if v == best} if best <= 30 else {0})


def test_fill_keeps_cells_out_of_reach(spark):
    rows = [(x, y, 770 if (x, y) == (0, 0) else 511 if x == 3 else 0) for x in range(9) for y in range(5)]
    df = spark.createDataFrame(rows, "x long, y long, id long")
    out = {(r.x, r.y): (r.distance, r.id) for r in tiles.nearest_fill(df, 15, 4).collect()}
    assert len(out) == len(rows)
    for x, y, i in rows:  # the water keeps its id and does not spread, though distance goes across it
        d = 3 * max(x, y) + min(x, y)
        assert out[x, y] == ((d if d <= 15 else None), i or (770 if d <= 15 else 0))
    none = tiles.nearest_fill(df.where("id <> 770").unionByName(df.where("id = 770").selectExpr("x", "y", "0L as id")), 15, 4)
    assert none.count() == len(rows) and none.where("distance is not null").count() == 0


def test_rays_match_fine_steps():
    h = 10 + 4 * np.sin(np.arange(33)[None, :] / 3) * np.cos(np.arange(33)[:, None] / 4)
    m, hits = rays.bounds_of(h), 0
    for _ in range(60):
        o = np.array([*RNG.uniform(1, 31, 2), 18.0])
        d = np.array([*RNG.uniform(-1, 1, 2), RNG.uniform(-0.6, 0.1)])
        outcome, t = (v[0] for v in rays.march(h, m, o[None], d[None]))
        steps = np.arange(0, 80, 0.01)
        first = next((s for s in steps if 0 <= (o + d * s)[0] <= 32 and 0 <= (o + d * s)[1] <= 32 and (o + d * s)[2] <= rays.surface(h, *((o + d * s)[:2, None]))[0]), None)
        assert (outcome == "hit") == (first is not None)
        if first is not None:
            hits += 1
            assert abs(t - first) < 0.5
    assert hits > 10


def test_residency_walk_equals_settling():
    held: set = set()
    for x, y in [(0, 0), (300, -900), (5000, 5000), (5100, 5000)]:
        held, _ = track.advance(held, x, y)
    while True:
        held, load = track.advance(held, 5100, 5000)
        if not load:
            break
    assert held == track.settle(5100, 5000)


def test_catalog(spark, tmp_path):
    m = {"version": 1, "product": "dtm", "epsg": 3979, "tile_size": 512, "base_level": 0, "level_count": 2, "base_metres_per_texel": 1.0, "origin_metres": [0.0, 0.0], "extent_texels": [2048, 1024], "bands": 1, "nodata": -32767.0}
    cells = spark.range(3000).selectExpr("cast(id % 2 as int) as level", "id as x", "id % 1000 as y", "cast(id as float) as value")
    with pytest.raises(ValueError, match="extent_texels"):
        catalog.check(m | {"extent_texels": [2049, 1024]})
    catalog.write_product(cells, str(tmp_path), m)
    assert catalog.read_manifest(spark, str(tmp_path), "dtm") == m and catalog.covers_same_ground(m, m | {"level_count": 1})
    p = catalog.read_product(spark, str(tmp_path), "dtm")
    r = catalog.read_rect(p, 1, 500, 0, 100, 1000)
    assert r.count() == cells.where("level = 1 and x between 500 and 599").count()
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "PushedFilters" in plan


def test_text_and_grid(spark):
    one = spark.range(1)
    sizes = one.select(*[text.byte_count(F.lit(n)) for n in (0, 1024, 1085450, 152650649841)]).first()
    assert list(sizes) == ["0 B", "1.0 KiB", "1.0 MiB", "142.2 GiB"]
    r = one.select(text.last_segment(F.lit("a/b/c/")), text.content_range(F.lit("bytes 5-9/20"))["total"], text.md5_line(F.lit("x")), *grid.tile_of_texel(-513, 0)[:1]).first()
    assert list(r) == ["c", 20, None, -2]


def test_rays_plumb_under_ground_and_holes():
    h = np.full((9, 9), 5.0)
    h[4:6, 4:6] = np.nan
    o = np.array([[1.5, 1.5, 9.0], [1.5, 1.5, 9.0], [1.5, 1.5, 3.0], [4.5, 4.5, 9.0], [20.0, 1.0, 9.0], [0.5, 1.5, 9.0], [0.5, 4.5, 9.0]])
    d = np.array([[0, 0, -2.0], [0, 0, 1.0], [1.0, 0, 0], [0, 0, -1.0], [0, 0, -1.0], [1.0, 0, -1.0], [1.0, 0, -1.0]])
    outcome, t = rays.march(h, rays.bounds_of(h), o, d)
    assert outcome.tolist() == ["hit", "none", "abandoned", "none", "none", "hit", "hit"]
    assert abs(t[0] - 2) < 1e-9 and abs(t[5] - 4) < 1e-6 and abs(t[6] - 5.5) < 1e-6


def test_stitching_goes_on_below_four_ids():
    assert vector.stitch([[1, 2, 1], [1, 5, 6]]) == [[1, 2, 1, 5, 6]]
    assert vector.stitch([[7], [], [1, 2], [3, 2], [3, 4]]) == [[1, 2, 3, 4]]


def test_creep_is_round_and_keeps_planes(spark):
    rows = [(x, y, 100.0 if (x, y) == (8, 8) else 0.0) for x in range(17) for y in range(17)]
    grid = spark.createDataFrame(rows, "x long, y long, h double")
    got = {(r.x, r.y): r.h for r in terrain.creep(grid, 0.06).collect()}
    assert abs(got[8, 8] - (100 - 0.06 * 6 * 100 / 2)) < 1e-9 and abs(got[7, 8] - 3) < 1e-9 and abs(got[7, 7] - 1.5) < 1e-9
    plane = spark.createDataFrame([(x, y, 3.0 * x - 2.0 * y) for x in range(6) for y in range(6)], "x long, y long, h double")
    assert all(abs(r.h - (3 * r.x - 2 * r.y)) < 1e-9 for r in terrain.creep(plane, 0.5).collect())


def test_half_ceiling(spark):
    from tessera.functions import view

    v = [0.0, 1.0, 1.0001, -1.0001, 65504.0, 65505.0, -65505.0, -65520.0, 1e-8, -1e-8, 0.1, 2047.5, 2049.0, -2049.0]
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").select("i", view.ceiling_half(F.col("v")).alias("c")).orderBy("i").collect()]
    for x, c in zip(v, got, strict=True):
        half = np.float16(np.float32(x))
        want = half if float(half) >= np.float32(x) or np.isinf(half) else np.nextafter(half, np.float16(np.inf))
        assert c == float(want), (x, c, want)


def test_one_camera_carries_everything_onto_itself(spark):
    from tessera.functions import view

    cam = view.Camera((3.0, 1.0, 2.0), (0.8, 0.0, 0.6), (0.0, 0.5, 0.0), (0.6, 0.0, -0.8), 0.25, 32, 16)
    rows = [(x, y, 128, 64, 0.5 if (x + y) % 3 else 0.0, x + y) for x in range(32) for y in range(16)]
    frame = spark.createDataFrame(rows, "px long, py long, ox int, oy int, depth double, material int")
    got = {(r.px, r.py): (round(r.depth, 9), r.material) for r in view.carry(frame, cam, cam).collect()}
    assert got == {(x, y): (0.5, m) for x, y, _, _, dep, m in rows if dep}
    assert view.work_list(view.carry(frame, cam, cam).limit(0), 0, 32, 16).count() == 32 * 16
