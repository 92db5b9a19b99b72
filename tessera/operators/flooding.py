"""Standing water over a raster of many tiles: each tile alone, a graph of spills between border cells, each tile again.

1. Each tile is flooded from its own border (and from cells beside missing
   ones, where water leaves): every cell gets the border cell that its water
   spills over and the level at which it does.  Where two such basins touch,
   water passes between them at the higher of two levels.
2. Basins, and border cells of neighbouring tiles, make a graph whose edges are
   levels.  Of a tile's edges, and of those to tiles beside it, a least spanning
   forest tells the same levels, and of ``GROUP`` by ``GROUP`` tiles a forest
   over the cells that have edges to other groups.  The lowest way out of each
   of these is found by contraction: every basin spills over its lowest edge;
   those whose spills lead outside are settled, those that spill into each other
   become one (few rounds, joins alone).  Then each group settles its other cells.
3. Each tile is raised to what its basins reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage
from .lists import hops
from .tiles import SIZE, Box, cells_of, rows_of, to_tiles, unpack

#: The number of what lies outside; border cells are numbered tile by tile from 0 on.
OUTSIDE = -1
#: Tiles of a group's side.
GROUP = 8
_AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def flood_tile(h: np.ndarray, there: np.ndarray, seeds: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, basin) of each cell: the lowest level at which its water reaches a seed, and the name of that seed."""
    rows, cols = h.shape
    wide = cols + 2
    pad = lambda a, v: np.pad(a, 1, constant_values=v).ravel()
    height, done = pad(h, 0.0).tolist(), pad(~there, True).tolist()
    level, basin = height[:], pad(names, OUTSIDE).tolist()
    heap = []
    for at in np.flatnonzero(pad(seeds & there, False)).tolist():
        done[at] = True
        heap.append((height[at], at))
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    steps = [dx + dy * wide for dx, dy in _AROUND]
    while heap:
        here, at = pop(heap)
        own = basin[at]
        for step in steps:
            to = at + step
            if not done[to]:
                done[to] = True
                basin[to] = own
                up = height[to]
                if up < here:
                    up = here
                level[to] = up
                push(heap, (up, to))
    cut = lambda a, kind: np.array(a, kind).reshape(rows + 2, wide)[1:-1, 1:-1]
    return cut(level, np.float64), cut(basin, np.int64)


def least_pairs(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unordered pair of different names once, with its least weight."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low != high
    low, high, w = low[keep], high[keep], w[keep]
    order = np.lexsort((w, high, low))
    low, high, w = low[order], high[order], w[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[first], high[first], w[first]


def contract(a: np.ndarray, b: np.ndarray, w: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edges between the names in ``kept`` by which each two of them are joined at the least level that they are in the graph (a, b, w)."""
    names, at = np.unique(np.concatenate((a, b, kept)), return_inverse=True)
    ends, up, stands = at.tolist(), list(range(len(names))), [-1] * len(names)
    for k in ends[2 * len(a) :]:
        stands[k] = k

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    low, high, over = [], [], []
    for e in np.argsort(w, kind="stable").tolist():
        x, y = find(ends[e]), find(ends[len(a) + e])
        if x != y:
            up[x] = y
            if stands[y] < 0:
                stands[y] = stands[x]
            elif stands[x] >= 0:
                low.append(stands[x])
                high.append(stands[y])
                over.append(e)
    return names[np.array(low, int)], names[np.array(high, int)], w[np.array(over, int)]


def spread(a: np.ndarray, b: np.ndarray, w: np.ndarray, known: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, levels): what the graph (a, b, w) reaches from names whose levels are known, each at its least level."""
    names, at = np.unique(np.concatenate((a, b, known)), return_inverse=True)
    n = len(a)
    one, two = np.concatenate((at[:n], at[n : 2 * n])), np.concatenate((at[n : 2 * n], at[:n]))
    order = np.argsort(one, kind="stable")
    start = np.searchsorted(one[order], np.arange(len(names) + 1)).tolist()
    to, over = two[order].tolist(), np.concatenate((w, w))[order].tolist()
    heap = list(zip(levels.tolist(), at[2 * n :].tolist(), strict=True))
    heapq.heapify(heap)
    out: dict[int, float] = {}
    while heap:
        here, k = heapq.heappop(heap)
        if k not in out:
            out[k] = here
            for e in range(start[k], start[k + 1]):
                if to[e] not in out:
                    heapq.heappush(heap, (max(here, over[e]), to[e]))
    return names[np.array(list(out), int)], np.array(list(out.values()), float)


def _block(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return unpack(row["block"], "<f8").reshape(size, size), unpack(row["there"], bool)[: size * size].reshape(size, size)


def _tile(row: dict, size: int) -> tuple[np.ndarray, ...]:
    """(heights, there, border names, which cells are seeds, where water leaves) of a tile with the ring of cells around it."""
    h, there = _block(row, size)
    ring = np.zeros((size + 2, size + 2), bool)
    ring[1:-1, 1:-1] = there
    if row["around"] is not None:
        beside = np.frombuffer(row["around"], bool)
        ring[0], ring[-1] = beside[: size + 2], beside[size + 2 : 2 * size + 4]
        ring[1:-1, 0], ring[1:-1, -1] = beside[2 * size + 4 : 3 * size + 4], beside[3 * size + 4 :]
    whole = np.ones((size, size), bool)
    for dx, dy in _AROUND:
        whole &= ring[1 + dy : 1 + dy + size, 1 + dx : 1 + dx + size]
    leaves = there & ~whole
    border = np.zeros((size, size), bool)
    border[[0, -1]] = border[:, [0, -1]] = True
    names = np.where(border, row["number"] * size * size + np.arange(size * size).reshape(size, size), OUTSIDE)
    return h, there, names, (border | leaves) & there, leaves


def _spills(size: int):
    """Tiles -> (a, b, w): at which level water passes between basins, and from which it leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, there, names, seeds, leaves = _tile(row, size)
                level, basin = flood_tile(h, there, seeds, names)
                A, B, W = [basin[leaves & (names >= 0)]], [np.full(int((leaves & (names >= 0)).sum()), OUTSIDE)], [h[leaves & (names >= 0)]]
                for dx, dy in _AROUND[4:]:
                    at = np.s_[: size - dy, max(0, -dx) : size - max(0, dx)]
                    to = np.s_[dy:, max(0, dx) : size + min(0, dx)]
                    both = there[at] & there[to]
                    A.append(basin[at][both])
                    B.append(basin[to][both])
                    W.append(np.maximum(level[at], level[to])[both])
                a, b, w = least_pairs(*(np.concatenate(c) for c in (A, B, W)))
                a, b, w = contract(a, b, w, np.concatenate((a, b)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w)], names=["a", "b", "w"])

    return run


def _raise(size: int):
    """Tiles with the levels of their basins -> cells and the filled surface."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            h, there, names, seeds, _ = _tile(row, size)
            level, basin = flood_tile(h, there, seeds, names)
            known = sorted((m["a"], m["level"]) for m in row["levels"] or [])
            keys, values = (np.array([m[k] for m in known], t) for k, t in ((0, np.int64), (1, np.float64)))
            reached = np.full(basin.shape, -np.inf)
            inner = there & (basin != OUTSIDE)
            reached[inner] = values[np.searchsorted(keys, basin[inner])]
            yield cells_of(row["tx"], row["ty"], there.ravel(), {"h": h.ravel(), "filled": np.maximum(level, reached).ravel()}, size)

    return run


def _borders(size: int):
    """Tiles -> the four borders that they show: which cells are there, and how high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, there = _block(row, size)
                sides = [np.s_[0, :], np.s_[-1, :], np.s_[:, 0], np.s_[:, -1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k]], pa.int64()) for k in ("tx", "ty", "number")] + [pa.array([np.concatenate([there[s] for s in sides]).tobytes()], pa.binary()), pa.array([np.concatenate([h[s] for s in sides]).tobytes()], pa.binary())], names=["tx", "ty", "number", "is", "high"]
                )

    return run


def _meet(size: int, crossings: bool):
    """A tile's own border and those of the tiles beside it -> the ring around it, or the edges to those that come after it."""

    def line(sides: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """The part of a neighbour's border that faces us: a row, a column or a corner."""
        top, bottom, left, right = (sides[k * size : (k + 1) * size] for k in range(4))
        if dy:
            whole = bottom if dy < 0 else top
            return whole if dx == 0 else whole[-1:] if dx < 0 else whole[:1]
        return right if dx < 0 else left

    def cells(dx: int, dy: int) -> np.ndarray:
        """Indices, in a neighbour's tile, of that part."""
        y = [size - 1] if dy < 0 else [0] if dy > 0 else range(size)
        x = [size - 1] if dx < 0 else [0] if dx > 0 else range(size)
        return np.array([r * size + c for r in y for c in x])

    def around(beside: dict) -> bytes:
        ring = np.zeros((size + 2, size + 2), bool)
        for (dx, dy), m in beside.items():
            part = line(np.frombuffer(m["is"], bool), dx, dy)
            y = 0 if dy < 0 else size + 1 if dy > 0 else slice(1, size + 1)
            x = 0 if dx < 0 else size + 1 if dx > 0 else slice(1, size + 1)
            ring[y, x] = part[0] if dx and dy else part
        return np.concatenate((ring[0], ring[-1], ring[1:-1, 0], ring[1:-1, -1])).tobytes()

    def edges(own: dict, beside: dict) -> pa.RecordBatch:
        A, B, W = [], [], []
        facing = {(dx, dy): (-dx, -dy) for dx, dy in _AROUND}
        for (dx, dy), m in beside.items():
            if (dy, dx) < (0, 0):
                continue  # the other tile has these
            mine, theirs = cells(*facing[dx, dy]), cells(dx, dy)
            h0, h1 = line(np.frombuffer(own["high"], "<f8"), *facing[dx, dy]), line(np.frombuffer(m["high"], "<f8"), dx, dy)
            i0, i1 = line(np.frombuffer(own["is"], bool), *facing[dx, dy]), line(np.frombuffer(m["is"], bool), dx, dy)
            for shift in (0,) if dx and dy else (-1, 0, 1):
                k = np.arange(max(0, -shift), len(mine) - max(0, shift))
                k = k[i0[k] & i1[k + shift]]
                A.append(own["number"] * size * size + mine[k])
                B.append(m["number"] * size * size + theirs[k + shift])
                W.append(np.maximum(h0[k], h1[k + shift]))
        a, b, w = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((A, np.int64), (B, np.int64), (W, np.float64)))
        a, b, w = contract(a, b, w, np.concatenate((a, b)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], names=["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                beside = {(m["dx"], m["dy"]): m for m in row["beside"]}
                own = beside.pop((0, 0), None)
                if own is None:
                    continue  # no such tile
                if crossings:
                    yield edges(own, beside)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([row["tx"]], pa.int64()), pa.array([row["ty"]], pa.int64()), pa.array([around(beside)], pa.binary())], names=["tx", "ty", "around"])

    return run


def spill_levels(edges: DataFrame) -> DataFrame:
    """a, level: for each name but OUTSIDE the least level at which it is joined to OUTSIDE, by edges (a, b, w).

    A round takes each component's lowest edge (ties: by its ends).  Along such
    edges levels never rise, so a component whose chain leads outside is settled
    at its own edge, and one that is not is at least as high as that edge.
    What has no way out is left out.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    graph = stage(both.groupBy("a", "b").agg(F.min("w").alias("w")), "graph")
    state = stage(graph.select("a").distinct().where(F.col("a") != OUTSIDE).select("a", F.col("a").alias("part"), F.lit(float("-inf")).alias("level"), F.lit(False).alias("settled")), "levels")
    while True:
        spill = F.min(F.struct("w", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.col("b").alias("to")))
        lowest = stage(graph.where(F.col("a") != OUTSIDE).groupBy("a").agg(spill.alias("e")).select("a", "e.w", "e.to"), "lowest")
        if not lowest.limit(1).count():
            return state.where("settled").select("a", "level")
        back = lowest.select(F.col("a").alias("to"), F.col("to").alias("back"))
        root = (F.col("to") == OUTSIDE) | ((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")))
        chains = lowest.join(back, "to", "left").select(F.col("a").alias("key"), F.when(~F.coalesce(root, F.lit(False)), F.col("to")).alias("prev"))
        tops = hops(chains).select(F.col("key").alias("part"), "top")
        out = lowest.where(F.col("to") == OUTSIDE).select(F.col("a").alias("top"), F.lit(True).alias("out"))
        moves = tops.join(out, "top", "left").join(lowest.select(F.col("a").alias("part"), "w"), "part").select("part", "top", F.coalesce("out", F.lit(False)).alias("out"), "w")
        moves = stage(moves, "moves")
        met = state.join(moves, "part", "left")
        after = stage(met.select("a", F.coalesce("top", "part").alias("part"), F.when(F.col("settled") | F.col("w").isNull(), F.col("level")).otherwise(F.greatest("level", "w")).alias("level"), (F.col("settled") | F.coalesce("out", F.lit(False))).alias("settled")), "levels")
        name = lambda c: moves.select(F.col("part").alias(c), F.when(F.col("out"), F.lit(OUTSIDE)).otherwise(F.col("top")).alias(f"{c}2"))
        joined = graph.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a2", "a").cast("long").alias("a"), F.coalesce("b2", "b").cast("long").alias("b"), "w").where("a <> b")
        merged = stage(joined.groupBy("a", "b").agg(F.min("w").alias("w")), "graph")
        for t in (graph, state, lowest, moves):
            discard(t)
        graph, state = merged, after


def grouped_levels(edges: DataFrame, group) -> DataFrame:
    """What ``spill_levels`` gives, of edges whose names ``group(column)`` deals to groups that have few edges between them; a task holds the edges of one group."""
    cut = edges.select("a", "b", "w", F.when(F.col("a") != OUTSIDE, group(F.col("a"))).alias("ga"), F.when(F.col("b") != OUTSIDE, group(F.col("b"))).alias("gb"))
    inner = cut.where("ga is null or gb is null or ga = gb").select(F.coalesce("ga", "gb").alias("g"), "a", "b", "w")
    between = cut.where("ga <> gb")
    gates = between.select(F.inline(F.array(F.struct(F.col("ga").alias("g"), "a"), F.struct(F.col("gb").alias("g"), F.col("b").alias("a"))))).distinct()

    def parts(table: pa.Table):
        """Edges, and rows without a second end: names with a level."""
        a, w = np.asarray(table["a"]), np.asarray(table["w"])
        edge = np.asarray(table["b"].is_valid())
        b = np.asarray(table["b"].fill_null(OUTSIDE))
        return (a[edge], b[edge], w[edge]), a[~edge], w[~edge]

    def fewer(table: pa.Table) -> pa.Table:
        graph, kept, _ = parts(table)
        return pa.table(dict(zip("abw", contract(*graph, np.append(kept, OUTSIDE)), strict=True)))

    def rest(table: pa.Table) -> pa.Table:
        graph, known, levels = parts(table)
        names, level = spread(*graph, np.append(known, OUTSIDE), np.append(levels, -np.inf))
        keep = (names != OUTSIDE) & ~np.isin(names, known)
        return pa.table({"a": names[keep], "level": level[keep]})

    named = lambda df, w: inner.unionByName(df.select("g", "a", F.lit(None).cast("long").alias("b"), w.alias("w")))
    short = named(gates, F.lit(0.0)).groupBy("g").applyInArrow(fewer, "a long, b long, w double")
    levels = spill_levels(stage(short.unionByName(between.select("a", "b", "w")), "spills"))
    own = named(levels.join(gates, "a"), F.col("level")).groupBy("g").applyInArrow(rest, "a long, level double")
    return levels.select("a", "level").unionByName(own)


def fill_hollows(cells: DataFrame, value: str = "h", size: int = SIZE, box: Box | None = None, elsewhere: Callable | None = None) -> DataFrame:
    """x, y, h, filled of every cell (x, y, value): the level to which water stands before it finds a way off the raster.

    Water leaves at every cell that lacks one of its eight neighbours, so null
    heights are gaps that drain.  With a ``box`` its cells that are not given are
    as high as ``elsewhere(x, y)``.  A task unpacks one tile at a time; the graph
    between tiles has a node for each border cell, that between groups of tiles for each of theirs.
    """
    present = cells.where(F.col(value).isNotNull()).select("x", "y", F.col(value).cast("double").alias("v"))
    tiles = stage(to_tiles(present, "v", "<f8", size, box, elsewhere), "tiles")
    extent = tiles.agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0")).first()
    width = 1 if extent.x0 is None else extent.x1 - extent.x0 + 1
    numbered = tiles.select("tx", "ty", F.expr(f"(ty - {extent.y0 or 0}) * {width} + tx - {extent.x0 or 0}").alias("number"), "there", "block")
    shown = stage(numbered.mapInArrow(_borders(size), "tx long, ty long, number long, is binary, high binary"), "borders")
    sent = F.inline(F.array(*(F.struct((F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), "number", "is", "high") for dx, dy in ((0, 0), *_AROUND))))
    met = stage(shown.select(sent).groupBy("tx", "ty").agg(F.collect_list(F.struct("dx", "dy", "number", "is", "high")).alias("beside")), "met")
    rings = met.mapInArrow(_meet(size, False), "tx long, ty long, around binary")
    ready = stage(numbered.join(rings, ["tx", "ty"], "left"), "ready")
    kind = "a long, b long, w double"
    inner = ready.select("number", "there", "block", "around").mapInArrow(_spills(size), kind)
    edges = stage(inner.unionByName(met.mapInArrow(_meet(size, True), kind)), "spills")

    def group(a):
        number = F.floor(a / (size * size))
        return F.floor(F.floor(number / width) / GROUP) * (width // GROUP + 1) + F.floor(number % width / GROUP)

    own = grouped_levels(edges, group).withColumn("number", F.expr(f"a div {size * size}")).groupBy("number").agg(F.collect_list(F.struct("a", "level")).alias("levels"))
    return ready.join(own, "number", "left").select("tx", "ty", "number", "there", "block", "around", "levels").mapInArrow(_raise(size), "x long, y long, h double, filled double")
