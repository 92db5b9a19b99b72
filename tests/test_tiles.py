import numpy as np
import pytest

from tessera.operators import flooding, terrain, tiles
from tests import naive


@pytest.mark.parametrize(("shape", "density", "limit", "size"), [((40, 37), 0.02, 3000, 16), ((64, 64), 0.005, 60, 16)])
def test_nearest_fill_by_tiles_is_that_of_the_whole(spark, shape, density, limit, size):
    rng = np.random.default_rng(shape[1])
    ids = np.where(rng.random(shape) < density, rng.choice([511, 770, 1023, 1804], shape), 0)
    rows, cols = shape
    df = spark.createDataFrame([(int(c) - 11, int(r) - 5, int(ids[r, c])) for r in range(rows) for c in range(cols)], "x int, y int, id int")
    dist, _ = naive.nearest_seeds(ids, (ids != 0) & (ids >> 8 != 1))
    want = naive.nearest_ids(ids, (ids != 0) & (ids >> 8 != 1), limit)
    got = tiles.nearest_fill(df, limit, size).collect()
    assert len(got) == rows * cols
    for r in got:
        at = r.y + 5, r.x + 11
        assert (r.distance, r.id) == (int(dist[at]) if dist[at] <= limit else None, int(want[at]))


def test_cells_that_are_not_there(spark):
    df = spark.createDataFrame([(0, 0, 770), (40, 0, 0), (40, 3, 0), (90, 0, 0)], "x long, y long, id long")
    got = {(r.x, r.y): (r.distance, r.id) for r in tiles.nearest_fill(df, 150, 16).collect()}
    assert got == {(0, 0): (0, 770), (40, 0): (120, 770), (40, 3): (123, 770), (90, 0): (None, 0)}
    assert tiles.nearest_fill(df.limit(0), 150, 16).count() == 0


def rough(kind, shape, rng):
    rows, cols = shape
    y, x = np.indices(shape)
    if kind == "flat":
        return np.zeros(shape)
    if kind == "steps":
        return rng.integers(0, 4, shape).astype(float)
    if kind == "bowl":  # one lake over many tiles
        return np.hypot(x - cols / 2, y - rows / 2) + rng.random(shape) * 0.5 + 3 * (np.abs(x - cols / 2) > cols / 2 - 3)
    return np.sin(x / 5.0) * 9 + np.cos(y / 7.0) * 9 + rng.random(shape) * 4


def test_hollows_by_tiles_are_filled_as_in_one_heap(spark):
    """Rasters far apart: gaps drain, so each is on its own."""
    rng, cells = np.random.default_rng(5), {}
    for k, (kind, shape, holes) in enumerate([("waves", (50, 61), 0.0), ("bowl", (48, 48), 0.0), ("steps", (40, 40), 0.0), ("steps", (40, 33), 0.02), ("flat", (20, 20), 0.0), ("waves", (45, 45), 0.01)]):
        h = rough(kind, shape, rng)
        own = {(c - 20 + 1000 * k, r + 3): float(h[r, c]) for r in range(shape[0]) for c in range(shape[1]) if rng.random() >= holes}
        cells |= own
        if not holes:
            whole, level = terrain.flood(h)[0], naive.filled(own)
            assert all(whole[y - 3, x + 20 - 1000 * k] == v for (x, y), v in level.items())
    rows = [(x, y, v) for (x, y), v in cells.items()] + [(90000, 500, None)]
    df = spark.createDataFrame(rows, "x int, y int, h double")
    assert {(r.x, r.y): r.filled for r in flooding.fill_hollows(df, size=8).collect()} == naive.filled(cells)


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (1, 0, None)], "x int, y int, h double")
    assert [(r.x, r.filled) for r in flooding.fill_hollows(df, size=8).collect()] == [(0, 5.0)]
    assert flooding.fill_hollows(df.limit(0), size=8).count() == 0


def test_levels_of_a_graph(spark):
    rng = np.random.default_rng(3)
    for n, m in ((200, 380),):
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(-1, n, m), rng.integers(-1, n, m), rng.integers(0, 9, m))]
        edges = [e for e in edges if e[0] != e[1]]
        level = {-1: float("-inf")}
        while True:
            best = min(((max(level[a], w), b) for x, y, w in edges for a, b in ((x, y), (y, x)) if a in level and b not in level), default=None)
            if best is None:
                break
            level[best[1]] = best[0]
        got = {r.a: r.level for r in flooding.spill_levels(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
        del level[-1]
        assert got == level
