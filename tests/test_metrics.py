import math
import random

from pyspark.sql import functions as F

from tessera.operators import metrics, vector


def test_upper_median_without_gathering(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), 5.0, 1e12 * rnd.random()])) for _ in range(4001)] + [("one", 3.0), ("two", 2.0), ("two", 1.0), ("same", 7.0), ("same", 7.0), ("none", None), (None, 4.0), (None, 9.0), (None, 1.0)]
    rows += [("odd", v) for v in (float("nan"), 1.0, float("nan"))] + [("far", 1e300), ("far", -1e300), ("far", 0.0), ("far", 1.0)]
    df = spark.createDataFrame(rows, "step string, v double").repartition(5)
    got = {r.step: r for r in metrics.stats(df, "v", "step").collect()}
    assert set(got) == {k for k, _ in rows}
    for step, r in got.items():
        own = sorted((v for k, v in rows if k == step and v is not None), key=lambda v: (math.isnan(v), v))
        want = own[len(own) // 2] if own else None
        assert r.n == len(own) and (r.median == want or math.isnan(want) and math.isnan(r.median))
    plan = metrics.stats(df, "v", "step")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    whole = spark.createDataFrame([(k,) for k in (4, 1, 3, 2)], "v int")
    assert metrics.stats(whole, "v").first().median == 3


def test_smoothing_in_stretches_is_the_sequential_one(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([rnd.uniform(0, 3), 1.5]), rnd.uniform(-9, 9)) for k in [1] * 900 + [2] * 7 + [None] * 5] + [(3, 4.0, 2.5), (4, 1.0, 1.0), (4, 1.0, 8.0), (5, None, 1.0), (6, 0.0, 1.0), (6, 1e6, 2.0)]
    got = {r.k: r.smoothed for r in metrics.ewma(spark.createDataFrame(rows, "k int, t double, v double").repartition(4), "k", "t", "v").collect()}
    assert set(got) == {1, 2, None, 3, 4, 6}
    for k, out in got.items():
        own = sorted((t, v) for i, t, v in rows if i == k and t is not None)
        last, v = own[0]
        for t, x in own[1:]:
            v += metrics.alpha(t - last) * (x - v)
            last = t
        assert math.isclose(out, v, rel_tol=1e-9, abs_tol=1e-9)


def test_spans_of_strokes(spark):
    rnd = random.Random(6)
    lines = [(k, *(round(rnd.uniform(-20, 20) * 4) / 4 for _ in range(4)), rnd.choice([0.5, 1.0, 3.0, 8.5])) for k in range(150)]
    lines += [(900, 0.0, 0.0, 9.0, 0.0, 3.0), (901, 0.5, 9.0, 0.5, -9.0, 2.0), (902, 1.0, 1.0, 1.0, 1.0, 5.0), (903, 9.0, 0.5, -9.0, 0.5, 1.0), (904, -4.0, -4.0, 4.0, 4.0, 2.0)]
    df = spark.createDataFrame(lines, "stroke long, x double, y double, nx double, ny double, w double")
    got = {(r.stroke, r.x, r.y) for r in vector.stroke_convert(df).collect()}
    want = set()
    for k, x, y, nx, ny, w in lines:
        dx, dy = nx - x, ny - y
        if dx or dy:
            for cx in range(-26, 27):
                for cy in range(-26, 27):
                    px, py = cx + 0.5 - x, cy + 0.5 - y
                    t = min(max((px * dx + py * dy) / (dx * dx + dy * dy), 0.0), 1.0)
                    if (px - t * dx) ** 2 + (py - t * dy) ** 2 <= (w / 2) ** 2:
                        want.add((k, cx, cy))
    assert got == want


def test_a_long_stroke_is_not_a_box(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10000.0, 9000.0, 3.0)], "stroke long, x double, y double, nx double, ny double, w double")
    out = vector.stroke_convert(df)
    n = out.count()
    assert 40000 < n < 42000
    assert out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("n > 8").count() == 0
