import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.perimeter import Rect
from tessera.operators import coast, lists, regions, vector

RECT = Rect(0.0, 0.0, 10.0, 10.0)


def closed_seas(spark, frames, rect=RECT, within=25000.0):
    """For each frame's chains (rings as lists of points, islands as lists of points)."""
    rows = [(f, c, k, *(map(float, p) if p else (None, None)), len(pts) > 3 and pts[0] == pts[-1]) for f, chains in enumerate(frames) for c, pts in enumerate(chains) for k, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "frame int, chain long, pos long, x double, y double, closed boolean")
    rings = {}
    for r in coast.close_sea(df, rect, within).orderBy("pos").collect():
        rings.setdefault((r.frame, r.island, tuple(r.ring)), []).append((r.x, r.y))
    return [tuple([v for (f, i, _), v in rings.items() if (f, i) == (k, island)] for island in (False, True)) for k in range(len(frames))]


def inside(rings, p):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n += (y1 > p[1]) != (y2 > p[1]) and x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1) > p[0]
    return n % 2 == 1


#: Chains, places in the water, places on land, and how many rings and islands there are.
CASES = [
    ([[(-2, 5), (12, 5)]], [(5, 2)], [(5, 8)], (1, 0)),
    ([[(12, 5), (-2, 5)]], [(5, 8)], [(5, 2)], (1, 0)),
    ([[(7, 12), (7, 6), (3, 6), (3, 12)]], [(5, 8)], [(5, 4), (1, 8)], (1, 0)),
    ([[(3, 12), (3, 6), (7, 6), (7, 12)]], [(5, 4), (1, 8)], [(5, 8)], (1, 0)),
    ([[(-2, 5), (12, 5)], [(4, 2), (6, 2), (5, 3), (4, 2)], [(4, 8), (6, 8), (5, 9), (4, 8)]], [(3, 2.1)], [(5, 2.3), (5, 8.3)], (1, 1)),
    ([[(12, 5), (5, 5)]], [(8, 8)], [(8, 2)], (1, 0)),
    ([[(-2, 5), (12, 5)], [(-2, 3), (12, 3)]], [(5, 1)], [(5, 8)], (1, 0)),
    ([], [], [(5, 5)], (0, 0)),
    ([[(4, 2), (6, 2), (5, 3), (4, 2)]], [], [(5, 2.3), (1, 1)], (0, 0)),
    # a chain that leaves and returns is two pieces; two strips of sea
    ([[(-2, 2), (12, 2), (12, 20), (-3, 20), (-3, 8), (12, 8)], [(12, 6), (-2, 6)]], [(5, 1), (5, 7)], [(5, 4), (5, 9)], (2, 0)),
    # a missing point splits a chain, and the loose ends go to the nearest edge
    ([[(-2, 5), (4, 2), None, (6, 2), (12, 5)]], [(1, 1), (9, 1)], [(5, 1), (5, 8)], (2, 0)),
    # a ring across the border is opened
    ([[(8, 4), (12, 4), (12, 6), (8, 6), (8, 4)]], None, None, None),
    ([[(20, 20), (30, 30)], [(5, 5)], [(1, 1), None]], [], [(5, 5)], (0, 0)),
]


def test_seas_of_squares(spark):
    for (sea, islands), (chains, wet, dry, n) in zip(closed_seas(spark, [c[0] for c in CASES]), CASES, strict=True):
        assert n is None or (len(sea), len(islands)) == n, chains
        assert all(inside(sea + islands, p) for p in wet or ()) and not any(inside(sea + islands, p) for p in dry or ()), chains


def test_far_ends_are_dropped(spark):
    far, near = [(-2, 5), (5, 5)], [(-2, 8), (9.5, 8), (9.5, 8.5)]
    alone, both = closed_seas(spark, [[far], [far, near]], within=3.0)
    assert alone == ([], []) and len(both[0]) == 1


def test_repair_drops_what_is_shorter_than_all_it_clashes_with(spark):
    rows = [(1, (c, 0, 0), e, x, float(m)) for c, e, x, m in ((1, 1.0, 30.0, 5), (2, 2.0, 29.0, 3), (3, 3.0, 28.0, 4))]
    pieces = spark.createDataFrame(rows, "frame int, piece struct<chain: long, run: long, part: int>, entry double, exit double, metres double")
    alive, links = coast.alternating(pieces, RECT)
    assert [r.piece.chain for r in alive.collect()] == [1] and [(r.piece.chain, r.next.chain) for r in links.collect()] == [(1, 1)]


def test_ways_are_joined_end_to_end(spark):
    ways = [(1, 10, 1, 3), (1, 11, 3, 5), (1, 12, 5, 9), (2, 10, 1, 3), (1, 20, 50, 51), (1, 21, 51, 52), (1, 22, 52, 50), (1, 30, 3, 7), (1, 40, 60, 60), (1, 50, None, 3)]
    df = spark.createDataFrame(ways, "frame int, way long, first long, last long")
    got = sorted((r.frame, r.chain, r.place, r.way, r.closed) for r in coast.join_ways(df).collect())
    assert got == [(1, 10, 0, 10, False), (1, 10, 1, 11, False), (1, 10, 2, 12, False), (1, 20, 0, 20, True), (1, 20, 1, 21, True), (1, 20, 2, 22, True), (1, 30, 0, 30, False), (1, 40, 0, 40, True), (2, 10, 0, 10, False)]


def test_lists_and_rings_are_ranked(spark):
    rnd, links, want = random.Random(1), [], {}
    keys = list(range(3000))
    rnd.shuffle(keys)
    while keys:
        n = min(len(keys), rnd.choice([1, 2, 3, 17, 300]))
        own, keys, ring = keys[:n], keys[n:], rnd.random() < 0.5
        if ring:
            k = own.index(min(own))
            own = own[k:] + own[:k]
        for place, key in enumerate(own):
            links.append((key, own[place - 1] if place or ring else rnd.choice([None, 10**6 + key])))
            want[key] = (own[0], place, ring)
    df = spark.createDataFrame(links, "key long, prev long")
    assert {r.key: (r.head, r.place, r.ring) for r in lists.rank_lists(df).collect()} == want


def test_depths_of_a_tree(spark):
    tree = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 8), (8, 7), (9, 1)]
    df = spark.createDataFrame(tree, "region long, parent long")
    assert {r.region: r.depth for r in regions.depths(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 0, 7: 100, 8: 100, 9: 1}


def test_neighbours_along_a_line(spark):
    rnd = random.Random(3)
    rows = [(k % 3, rnd.choice([rnd.uniform(0, 40), 7.5, 40.0]), k) for k in range(400)] + [(9, 1.0, 1000)]
    df = spark.createDataFrame(rows, "line int, t double, k long")
    for cyclic in (True, False):
        got = {r.k: r.after for r in lists.following(df, ["line"], F.col("t"), 40.0, [F.col("t"), F.col("k")], F.col("k"), cyclic).collect()}
        for line in (0, 1, 2, 9):
            own = sorted((t, k) for i, t, k in rows if i == line)
            assert [got[k] for _, k in own] == [k for _, k in own[1:]] + [own[0][1] if cyclic else None]


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_points_in_rings_of_any_shape(spark, cell):
    rnd, rings = random.Random(6), {}
    for k in range(25):
        cx, cy, n = rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.choice([3, 4, 9, 40])
        rings[k] = [(cx + rnd.uniform(1, 9) * math.cos(2 * math.pi * i / n), cy + rnd.uniform(1, 9) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings[90], rings[91] = [(-3.0, -3.0), (3.0, 3.0), (3.0, -3.0), (-3.0, 3.0)], [(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (5.0, 0.0)]
    points = [(k, rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for k in range(400)] + [(1000 + k, float(k % 7), float(k // 7)) for k in range(49)]
    corners = spark.createDataFrame([(r, i, x, y) for r, ps in rings.items() for i, (x, y) in enumerate(ps)], "ring long, pos long, x double, y double")
    got = {(r.i, r.ring) for r in vector.points_in_rings(spark.createDataFrame(points, "i long, px double, py double"), vector.ring_edges(corners), cell, ("i",)).collect()}
    assert got == {(k, r) for k, x, y in points for r, ring in rings.items() if inside([ring], (x, y))}


def settled(metres, entry, exit_):
    """The rounds of the repair, one by one: pieces left, and whose entry follows whose exit."""
    left = list(range(len(metres)))
    while True:
        ends = sorted((t, p, not comes) for p in left for t, comes in ((entry[p], True), (exit_[p], False)))
        pairs = [(a[1:], b[1:]) for a, b in zip(ends, ends[1:] + ends[:1])]
        beside = {}
        for (p, c), (q, d) in pairs:
            if c == d:
                beside.setdefault(p, []).append(q)
                beside.setdefault(q, []).append(p)
        gone = {p for p, others in beside.items() if all((metres[p], p) <= (metres[q], q) for q in others)}
        if not gone:
            return left, {p: q for (p, c), (q, _) in pairs if c}
        left = [p for p in left if p not in gone]


def test_repair_in_a_task_takes_the_same_rounds():
    rnd = random.Random(7)
    for k in range(600):
        n = rnd.choice([1, 2, 3, 5, 12, 60])
        place = lambda: rnd.choice([rnd.uniform(0, 40), float(rnd.randrange(8))])
        metres, entry, exit_ = [float(rnd.randrange(1, n + 3)) for _ in range(n)], [place() for _ in range(n)], [place() for _ in range(n)]
        left, after = coast.repaired(np.array(metres), np.array(entry), np.array(exit_))
        own, links = settled(metres, entry, exit_)
        assert list(np.flatnonzero(left)) == own and {p: after[p] for p in own} == links, k


def test_frames_of_a_task_and_larger_ones_agree(spark):
    rnd = random.Random(8)
    rows = [(f, (rnd.randrange(5), rnd.randrange(10**6), c), rnd.uniform(0, 40), rnd.uniform(0, 40), float(rnd.randrange(1, 9))) for f, n in ((1, 30), (2, 90), (3, 1)) for c in range(n)] + [(None, (1, 1, 1), 1.0, 2.0, 3.0)]
    pieces = spark.createDataFrame(rows, "frame int, piece struct<chain: long, run: long, part: int>, entry double, exit double, metres double")
    got = [sorted(map(tuple, coast.linked(pieces, RECT, most).collect())) for most in (10**6, 30, 0)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {1, 2, 3}


def test_rounds_of_the_repair_are_no_jobs(spark):
    """Forty strips one above the other, of one length: one goes in each round."""
    spark.sparkContext.setJobGroup("strips", "strips")
    ((sea, islands),) = closed_seas(spark, [[[(-2, 1 + c / 10), (12, 1 + c / 10)] for c in range(40)]])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("strips")
    spark.sparkContext.setJobGroup("", "")
    assert (len(sea), len(islands)) == (1, 0) and inside(sea, (5, 4)) and not inside(sea, (5, 5)) and len(jobs) < 60
