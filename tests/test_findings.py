"""Small tables on which the queries of the third and fourth reviews' findings went wrong."""

import math
import os

from pyspark.sql import functions as F

from tessera.functions import text


def test_byte_count_stops_at_the_largest_unit(spark):
    one = spark.range(1).select(text.byte_count(F.lit(3 << 40), "GiB").alias("g"), text.byte_count(F.lit(3 << 40)).alias("t")).first()
    assert (one.g, one.t) == ("3072.0 GiB", "3.0 TiB")


def test_parent_chain_recurses_over_nodes_not_customers(spark, tmp_path):
    from tessera.plans.queries import parent_chain

    spark.range(300).selectExpr("id as c_custkey", "if(id = 7, null, id % 3) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("id as n_nationkey", "id + 5 as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {r.c_custkey: (r.depth, r.root) for r in parent_chain(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert got == {i: (1, None) if i == 7 or i % 3 == 2 else (2, f"r{i % 3 + 5}") for i in range(300)}


def test_streams_append_to_files_and_not_to_the_driver(spark):
    from tessera.plans.queries import residency_stream, smoothed_stream

    for f in (residency_stream, smoothed_stream):
        assert f(spark, "/root/testdata/sf0.001").inputFiles()


def test_paint_sorts_no_covers(spark):
    from tessera.operators.vector import paint

    rows = [(0, 0, 1, 2.0, 5, 50), (0, 0, 2, 9.0, 6, 60), (0, 0, 2, 3.0, 7, 70), (0, 0, 2, 3.0, 8, 80), (1, 0, 1, 2.0, 9, 90), (2, 0, None, None, 9, 91)]
    out = paint(spark.createDataFrame(rows, "x int, y int, layer int, area double, index long, id long"))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(0, 0, 80), (1, 0, 90), (2, 0, 91)]


def test_points_that_coincide_are_tested_once(spark):
    from tessera.operators import vector

    corners = [(0, 0.0, 0.0), (1, 9.0, 0.0), (2, 9.0, 9.0), (3, 0.0, 9.0)]
    edges = vector.ring_edges(spark.createDataFrame([(1, *c) for c in corners], "ring long, pos int, x double, y double"))
    points = spark.range(200).selectExpr("id as i", "cast(id % 2 * 20 + 1 as double) as px", "1.5D as py")
    at, spots = vector.at_spots(points, ("i",))
    assert spots.count() == 2 and at.count() == 200
    assert sorted(r.i for r in vector.points_in_rings(points, edges, 4, ("i",)).collect()) == list(range(0, 200, 2))


def test_a_sampled_point_meets_one_row(spark):
    from tessera.operators import fields

    cells = spark.range(36).selectExpr("id % 6 as x", "id div 6 as y", "cast(id as double) as h").where("x <> 5 or y <> 5")
    around = fields._around(cells, (6, 6), ("h",))
    assert around.groupBy("__kx", "__ky").count().where("count > 1").count() == 0 and around.where("size(__cells) <> 32").count() == 0
    points = spark.createDataFrame([(1, 2.0, 2.5), (2, -90.0, -90.0), (3, 5.0, 5.0)], "i int, x double, y double")
    got = {r.i: (r.h, r.slope) for r in fields.sample(points, cells, ("i",), (6, 6), 1.0, ("h",)).collect()}
    assert set(got) == {1, 2} and abs(got[1][0] - 17.0) < 1e-9 and got[2] == (0.0, 0.0)


def test_tiles_are_as_small_in_memory_as_in_files(spark):
    """Blocks that Spark deflated only in files and shuffles came to hundreds of MB in one Arrow batch."""
    from tessera.operators import tiles

    got = tiles.to_tiles(spark.createDataFrame([(1, 2, 770), (30, 40, 1023)], "x long, y long, id long"), "id", "<i8").first()
    assert len(got.there) + len(got.block) < 20000
    cells = tiles.unpack(got.block, "<i8").reshape(tiles.SIZE, tiles.SIZE)
    assert (cells[2, 1], cells[40, 30], cells.sum()) == (770, 1023, 1793) and tiles.unpack(got.there, bool).sum() == 2


def test_a_box_stands_for_its_holes(spark):
    from tessera.operators import tiles

    rows = [(3, 4, 1804), (17, 9, 770), (30, 2, 511), (40, 2, 770), (None, 2, 770)]
    some = spark.createDataFrame(rows, "x long, y long, id long")
    want = spark.range(36 * 12).selectExpr("id % 36 as x", "id div 36 as y").join(some, ["x", "y"], "left").selectExpr("x", "y", "coalesce(id, 0) as id")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = tiles.nearest_fill(some, 60, 16, box=(0, 0, 36, 12))
    assert key(got) == key(tiles.nearest_fill(want, 60, 16)) and got.count() == 36 * 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


def test_fewer_spills_tell_the_same_levels(spark):
    """Between groups of tiles only the cells at their borders take part in the rounds."""
    import numpy as np

    from tessera.operators import flooding

    rng = np.random.default_rng(8)
    a, b, w = rng.integers(-1, 120, 500), rng.integers(-1, 120, 500), rng.integers(0, 30, 500).astype(float)
    a, b, w = (c[a != b] for c in (a, b, w))
    edges = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w, strict=True)], "a long, b long, w double")
    names, level = flooding.spread(a, b, w, np.array([-1]), np.array([-np.inf]))
    want = {n: v for n, v in zip(names.tolist(), level.tolist(), strict=True) if n != -1}
    assert {r.a: r.level for r in flooding.grouped_levels(edges, lambda c: F.floor(c / 40)).collect()} == want
    some = np.array([-1, 3, 50, 77])
    few = flooding.contract(a, b, w, some)
    assert len(few[0]) == 3 and set(few[0]) | set(few[1]) == set(some.tolist())
    for n in some:
        full, short = (dict(zip(*(c.tolist() for c in flooding.spread(*g, np.array([n]), np.array([-np.inf]))), strict=True)) for g in ((a, b, w), few))
        assert all(full[m] == short[m] for m in some.tolist())


def test_extract_files_are_as_many_as_tasks(spark, monkeypatch):
    """Four files were written at any size."""
    from tessera.plans.files import osm_extract

    parts = []
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c: (parts.append(n), plain(self, n, *c))[1])
    assert osm_extract(spark, "/root/testdata/sf0.001").count() and parts == [8, 8, 8]


def test_blocks_are_written_from_slices_and_nulls():
    import pyarrow as pa

    from tessera.sources import pbf

    ways = [{"id": k * (-1) ** k, "refs": None if k % 5 == 0 else [k << 40, -k, 3][: k % 4], "tags": None if k % 3 == 0 else [("a", None), ("", "b")][: k % 3]} for k in range(30)]
    cut = pa.RecordBatch.from_pylist(ways, schema=pbf._ARROW["way"]).slice(7, 12)
    got = pbf.elements(pbf.block(cut, "way"), "way").to_pylist()
    assert got == [{"id": w["id"], "refs": w["refs"] or [], "tags": [(k, v or "") for k, v in w["tags"] or []]} for w in ways[7:19]]
    member = {"type": "node", "ref": -5, "role": None}
    relations = pa.RecordBatch.from_pylist([{"id": 1, "members": None}, {"id": 2, "members": [member, member | {"type": "relation", "role": "x"}]}], schema=pbf._ARROW["relation"])
    assert [r["members"] for r in pbf.elements(pbf.block(relations, "relation"), "relation").to_pylist()] == [[], [member | {"role": ""}, member | {"type": "relation", "role": "x"}]]


def test_smoothed_stream_puts_all_rows_of_a_key_in_order(spark, tmp_path):
    """Rows of later chunks were taken as they came: exp overflowed from 178 s back, and less gave a wrong average."""
    from tessera.plans.queries import smoothed_stream

    ids = [(i * 7919 % 40) * 100000 for i in range(40)]
    for n in range(4):
        spark.createDataFrame([(e, u, float(e % 700001 + u)) for e in ids[n::4] for u in (1, 2)], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u in (1, 2):
        for e in sorted(ids):
            x = float(e % 700001 + u)
            m = x if e == 0 else m + (1 - math.exp((before - e) / 10000.0 / 0.25)) * (x - m)
            before, want[u, e / 10000.0] = e, m
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = smoothed_stream(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 80 and {(r.user_id, r.seconds) for r in got} == set(want)
    assert all(abs(r.smoothed - want[r.user_id, r.seconds]) < 1e-6 for r in got)


def test_smoothed_stream_takes_rows_that_come_a_batch_late(spark, tmp_path):
    from tessera.plans.queries import _drain
    from tessera.streaming import track

    schema = "user_id long, seconds double, value double"
    for n, rows in enumerate([[(1, 500.0, 8.0), (1, 500.25, 4.0)], [(1, 3.0, 99.0), (1, 500.5, 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
        for f in (tmp_path / f"{n}.parquet").iterdir():
            os.utime(f, (1000 + n, 1000 + n))
    rows = _drain(track.smoothed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")), "late").collect()
    got = {r.seconds: r.smoothed for r in rows}
    e = math.exp(-1)
    assert len(rows) == 4 and got[500.0] == 8.0 and got[3.0] == got[500.25]
    assert abs(got[500.25] - (4 + 4 * e)) < 1e-9 and abs(got[500.5] - (4 + 4 * e * e)) < 1e-9
