import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.extract import extract
from tessera.sources import pbf


def test_numbers():
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> rng.integers(0, 63, 500).astype(np.uint64), np.array([0, 1, 127, 128, (1 << 64) - 1], np.uint64)))
    packed = pbf.pack_varints(v)

    def slow(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    assert packed == b"".join(slow(int(x)) for x in v) and (pbf.varints(packed) == v).all()
    s = np.array([0, -1, 1, -(1 << 63), (1 << 63) - 1, -64, 64])
    assert (pbf.signed(pbf.zigzag(s)) == s).all() and pbf.zigzag(s[:3]).tolist() == [0, 1, 2]
    assert pbf.varints(b"").tolist() == []
    for bad in (b"\x80", b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            pbf.varints(bad)


def sample(kind, n, seed=0):
    rnd = random.Random(seed)
    tags = lambda: {rnd.choice(["natural", "name", "é"]): rnd.choice(["wood", "", "Ωmega"]) for _ in range(rnd.randrange(3))}
    out = []
    for i in range(n):
        row = {"id": i * 3 - 20 if i % 7 else (1 << 40) + i, "tags": list(tags().items())}
        if kind == "node":
            row |= {"lat": round(rnd.uniform(-90, 90), 7), "lon": round(rnd.uniform(-180, 180), 7)}
        elif kind == "way":
            row |= {"refs": [rnd.randrange(-99, 1 << 34) for _ in range(rnd.randrange(5))]}
        else:
            row |= {"members": [{"type": rnd.choice(pbf.KINDS), "ref": rnd.randrange(99), "role": rnd.choice(["", "outer"])} for _ in range(rnd.randrange(4))]}
        out.append(row)
    return out


@pytest.mark.parametrize("kind", pbf.KINDS)
def test_blocks(kind):
    rows = sample(kind, 300)
    data = pbf.inflate(pbf.message((1, pbf.block(rows, kind))))
    got = pbf.elements(data, kind).to_pylist()
    assert pbf.first_kind(data) == kind
    for g, r in zip(got, rows, strict=True):
        if kind == "node":
            assert (round(g.pop("lat"), 7), round(g.pop("lon"), 7)) == (r.pop("lat"), r.pop("lon"))
        assert g == r
    assert all(pbf.elements(data, k).num_rows == 0 for k in pbf.KINDS if k != kind)


def plain_block():
    """Single nodes with offsets and another unit, a way with a repeated key, in one block with two groups."""
    words = pbf.message(*((1, w) for w in (b"", b"k", b"first", b"second")))
    z = lambda x: int(pbf.zigzag(np.array([x]))[0])
    node = pbf.message((1, z(-5)), (2, b"\x01"), (3, b"\x02"), (8, z(100)), (9, z(-200)))
    way = pbf.message((1, 7), (2, b"\x01\x01"), (3, b"\x02\x03"), (8, pbf.pack_varints(pbf.zigzag(np.array([5, -1, 1])))))
    minus = (1 << 64) - 3000
    return pbf.message((1, words), (2, pbf.message((1, node))), (2, pbf.message((3, way))), (17, 1000), (19, 2000), (20, minus))


def test_single_nodes_and_repeated_keys():
    node, way = (pbf.elements(plain_block(), k).to_pylist() for k in ("node", "way"))
    assert node == [{"id": -5, "lat": pytest.approx((2000 + 100000) * 1e-9), "lon": pytest.approx((-3000 - 200000) * 1e-9), "tags": [("k", "first")]}]
    assert way == [{"id": 7, "refs": [5, 4, 5], "tags": [("k", "first")]}] and pbf.elements(plain_block(), "relation").num_rows == 0


def write_file(path, blocks, is_sorted):
    path.write_bytes(pbf.header(is_sorted) + b"".join(pbf.framed("OSMData", b) for b in blocks))


@pytest.mark.parametrize("is_sorted", [True, False])
def test_blobs_of_other_kinds_are_not_read(spark, tmp_path, is_sorted):
    rows = {k: sample(k, 400, 3) for k in pbf.KINDS}
    blocks = [pbf.block(rows[k][i : i + 20], k) for k in pbf.KINDS for i in range(0, 400, 20)]
    write_file(tmp_path / "a.osm.pbf", blocks, is_sorted)
    pbf.register(spark)
    for k in pbf.KINDS:
        parts = pbf.Reader({"path": str(tmp_path / "a.osm.pbf"), "kind": k, "partition_bytes": "3000"}).partitions()
        places = [p for s in parts for p in s.places]
        assert len(places) == 60 if not is_sorted else 20 <= len(places) <= 21 and len(parts) > 1
        df = spark.read.format("osm_pbf").option("kind", k).option("partition_bytes", "3000").load(str(tmp_path / "a.osm.pbf"))
        assert sorted(r.id for r in df.collect()) == sorted(r["id"] for r in rows[k])
    with pytest.raises(Exception, match="kind must be"):
        spark.read.format("osm_pbf").load(str(tmp_path)).count()


def test_damaged_files(tmp_path):
    good = pbf.header(True) + pbf.framed("OSMData", pbf.block(sample("node", 5), "node"))
    for bad in (good[:-3], good[:10], b"\xff" * 20, good + b"\x00"):
        (tmp_path / "x.pbf").write_bytes(bad)
        with pytest.raises(ValueError):
            pbf.Reader({"path": str(tmp_path / "x.pbf"), "kind": "node"}).partitions()
    with pytest.raises(ValueError):
        pbf.inflate(pbf.message((2, 9), (3, zlib.compress(b"1234"))))
    with pytest.raises(ValueError):
        pbf.inflate(pbf.message((7, b"zstd")))
    (tmp_path / "x.pbf").write_bytes(pbf.header(False))
    assert pbf.Reader({"path": str(tmp_path / "x.pbf"), "kind": "node"}).partitions() == []
    assert struct.unpack(">I", good[:4])[0] < 64


def test_commit_and_abort(spark, tmp_path):
    pbf.register(spark)
    at = str(tmp_path / "out")
    df = spark.range(5000).select(F.col("id"), (F.col("id") / 100).alias("lat"), F.lit(1.5).alias("lon"), F.expr("map('k', cast(id as string))").alias("tags")).repartition(3)
    df.write.format("osm_pbf").mode("append").option("kind", "node").save(at)
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert sum(n.endswith(".osm.pbf") for n in names) == 3 and sum(n.startswith("_SUCCESS-node-") for n in names) == 1 and len(names) == 4
    back = spark.read.format("osm_pbf").option("kind", "node").load(at)
    assert back.count() == 5000 and {(r.id, round(r.lat, 7), r.lon, r.tags["k"]) for r in back.collect()} == {(i, i / 100, 1.5, str(i)) for i in range(5000)}
    bad = df.withColumn("id", F.when(F.col("id") != 17, F.col("id")))
    with pytest.raises(Exception, match="no id"):
        bad.write.format("osm_pbf").mode("append").option("kind", "node").save(at)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "_temporary" not in p.name) == sorted(names)
    assert spark.read.format("osm_pbf").option("kind", "node").load(at).count() == 5000
    with pytest.raises(Exception, match="have the columns"):
        df.drop("lat").write.format("osm_pbf").mode("append").option("kind", "node").save(at)


def test_three_passes(spark):
    frames = {
        "relation": [(1, [("way", 10, "outer"), ("node", 11, ""), ("way", 99, "")], {"type": "lake"}), (2, [("way", 11, "")], {"type": "route"}), (3, [], None)],
        "way": [(10, [1, 2], {}), (11, [3], {}), (12, [4, 5, 4], {"natural": "wood"}), (13, None, {"natural": "wood"}), (14, [6], None)],
        "node": [(i, float(i), 0.0, {}) for i in range(1, 9)],
    }
    out = extract(lambda k: spark.createDataFrame(frames[k], pbf._SCHEMAS[k]), F.col("tags")["natural"] == "wood", F.col("tags")["type"] == "lake")
    assert sorted((r.id, r.own) for r in out["way"].collect()) == [(10, False), (12, True), (13, True)]
    assert sorted(r.id for r in out["node"].collect()) == [1, 2, 4, 5] and [r.id for r in out["relation"].collect()] == [1]
    assert pa.schema(pbf._ARROW["way"]).names == ["id", "refs", "tags"]
