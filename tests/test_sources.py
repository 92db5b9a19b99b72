"""Files, catalogues and products."""

import json

import numpy as np
import pytest

from tessera.sources import catalog, geotiff, stac


@pytest.mark.parametrize("values", [np.arange(70 * 33, dtype=np.float32).reshape(70, 33), np.arange(600, dtype=np.uint32).reshape(20, 30), np.arange(16 * 16 * 3, dtype=np.uint8).reshape(16, 16, 3)])
def test_geotiff_round_trip(values):
    p = geotiff.Placed(values, -1974272.0, 524288.5, 2.0, 3979, -32767.0 if values.dtype.kind == "f" else None)
    q = geotiff.decode(geotiff.encode(p))
    assert np.array_equal(p.values, q.values) and (p.west, p.north, p.metres, p.epsg, p.nodata) == (q.west, q.north, q.metres, q.epsg, q.nodata)


def test_geotiff_refuses():
    raw = geotiff.encode(geotiff.Placed(np.zeros((4, 4), np.float32), 0.0, 0.0, 1.0, 3979))
    feet = raw.replace((3076).to_bytes(2, "little") + b"\0\0\1\0" + (9001).to_bytes(2, "little"), (3076).to_bytes(2, "little") + b"\0\0\1\0" + (9002).to_bytes(2, "little"))
    assert feet != raw
    for bad in (feet, b"PK\3\4" + raw[4:]):
        with pytest.raises(ValueError):
            geotiff.decode(bad)
    point = raw.replace((1025).to_bytes(2, "little") + b"\0\0\1\0\1\0", (1025).to_bytes(2, "little") + b"\0\0\1\0\2\0")
    assert (geotiff.decode(point).west, geotiff.decode(point).north) == (-0.5, 0.5)


def test_items_and_regions(spark):
    item = lambda i, box, epsg, assets: {"id": i, "bbox": box, "properties": {"proj:epsg": epsg}, "assets": {a: {"href": f"h/{i}/{a}"} for a in assets}}
    body = json.dumps({"features": [item("a", [0, 0, 1, 1], 3979, ["dtm"]), item("b", [5, 5, 6, 6], 3979, ["dtm"]), item("c", [0, 0, 1, 1], 3979, ["dsm"])], "links": [{"rel": "next", "href": "n"}]})
    pages = spark.createDataFrame([(body,), (None,)], "body string")
    assert [(r.id, r.href) for r in stac.items(pages, "dtm", 3979, (0.5, 0.5, 2, 2)).collect()] == [("a", "h/a/dtm")]
    assert [r.href for r in stac.next_page(pages).collect()] == ["n"]
    other = spark.createDataFrame([(json.dumps({"features": [item("z", [0, 0, 1, 1], 26910, ["dtm"])]}),)], "body string")
    with pytest.raises(Exception, match="not in EPSG"):
        stac.items(other, "dtm", 3979, (0, 0, 2, 2)).collect()
    square = [[0, 0], [4, 0], [4, 4], [0, 4]]
    index = {"features": [{"properties": {"id": i, "name": i, "urls": {"pbf": "u"} if i != "q" else {}}, "geometry": {"type": t, "coordinates": c}} for i, t, c in [("p", "Polygon", [square, square]), ("m", "MultiPolygon", [[square], [square]]), ("q", "Polygon", [square]), ("l", "Point", [1, 2])]]}
    got = stac.regions(spark.createDataFrame([(json.dumps(index),)], "body string")).collect()
    assert len(got) == 16 and {(r.ring, r.hole) for r in got} == {("p/0/0", False), ("p/0/1", True), ("m/0/0", False), ("m/1/0", False)}


def test_products(spark, tmp_path):
    m = {"version": 1, "product": "dtm", "epsg": 3979, "tile_size": 512, "base_level": 0, "level_count": 1, "base_metres_per_texel": 1.0, "origin_metres": [0.0, 0.0], "extent_texels": [1024, 512], "bands": 1, "nodata": -32767.0}
    assert catalog.find_product(spark, str(tmp_path), "dtm") is None
    rows = [(0, 510, 5, 1.5), (0, 513, 6, 2.5)]
    catalog.write_product(spark.createDataFrame(rows, "level int, x long, y long, h float"), str(tmp_path), m)
    p = catalog.typed(catalog.find_product(spark, str(tmp_path), "dtm"), "h", "float")
    with pytest.raises(TypeError):
        catalog.typed(p, "h", "int")
    got = {(r.x, r.y): r.h for r in catalog.dense_rect(p, 0, 509, 4, 6, 4, -32767.0).collect()}
    assert len(got) == 24 and got[510, 5] == 1.5 and got[513, 6] == 2.5 and sum(v == -32767.0 for v in got.values()) == 22
    broken = spark.createDataFrame([(0, 1, 1, 1.0)], "level int, x long, y long, h float").selectExpr("level", "x", "y", "raise_error('killed') as h")
    with pytest.raises(Exception, match="killed"):
        catalog.write_product(broken, str(tmp_path), m)
    assert catalog.find_product(spark, str(tmp_path), "dtm") is None
