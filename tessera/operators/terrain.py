"""Neighbourhood and flow analytics.

Stencils are equi-joins of a cell table with its shifted self, one job a sweep.
Sequential kernels (flood, accumulation, incision, droplets, two-pass fill) run
on one grid a group: scale-out is by independent grid or basin.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Neighbours in tie order.
NEIGHBOURS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]
OPPOSITE = [1, 0, 3, 2, 7, 6, 5, 4]
SPREAD = 1.1


def _reach(dx: int, dy: int) -> float:
    return math.sqrt(2) if dx and dy else 1.0


def neighbours(cells: DataFrame, value: str = "h") -> DataFrame:
    """x, y, slot, reach and the value of each neighbour that exists: every cell offers itself to its eight neighbours."""
    offer = F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(k).alias("slot"), F.lit(_reach(dx, dy)).alias("reach")) for k, (dx, dy) in enumerate(NEIGHBOURS)))
    return cells.select(F.col(value).alias("other"), F.inline(offer))


def creep(cells: DataFrame, rate: float, value: str = "h") -> DataFrame:
    """One diffusion sweep over the eight neighbours, corners at half weight, the sum halved; beyond an edge the surface goes on straight (2 * here - opposite)."""
    near = neighbours(cells, value).groupBy("x", "y").agg(*(F.max(F.when(F.col("slot") == k, F.col("other"))).alias(f"n{k}") for k in range(8)))
    all_ = cells.join(near, ["x", "y"], "left")
    here, bend = F.col(value), F.lit(0.0)
    for k, o in enumerate(OPPOSITE):
        side = F.coalesce(F.col(f"n{k}"), 2 * here - F.col(f"n{o}"), here)
        bend = bend + (1.0 if k < 4 else 0.5) * (side - here)
    return all_.select("x", "y", (here + rate * bend / 2).alias(value))


def thermal(cells: DataFrame, talus: float, share: float = 0.5, value: str = "h") -> DataFrame:
    """One relaxation sweep: a cell sheds ``share`` of its steepest excess over the talus, split by excess; gathered, so nothing is lost."""
    pairs = cells.join(neighbours(cells, value), ["x", "y"], "left")
    excess = F.greatest((F.col(value) - F.col("other")) - talus * F.col("reach"), F.lit(0.0))
    pairs = pairs.withColumn("excess", F.coalesce(excess, F.lit(0.0)))
    shed = pairs.groupBy("x", "y").agg(F.first(value).alias(value), F.max("excess").alias("top"), F.sum("excess").alias("all"))
    out = F.when(F.col("all") > 0, share * F.col("top")).otherwise(F.lit(0.0))
    moved = pairs.where("excess > 0").join(shed.select("x", "y", out.alias("out"), "all"), ["x", "y"])
    step = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS))
    to = F.element_at(step, F.col("slot") + 1)
    got = moved.groupBy((F.col("x") + to["dx"]).alias("x"), (F.col("y") + to["dy"]).alias("y")).agg(F.sum(F.col("out") * F.col("excess") / F.col("all")).alias("got"))
    return shed.join(got, ["x", "y"], "left").select("x", "y", (F.col(value) - out + F.coalesce("got", F.lit(0.0))).alias(value))


def receivers(cells: DataFrame, value: str = "h") -> DataFrame:
    """x, y, slot, fall of the steepest neighbour strictly below; the first in order wins ties; absent where there is none."""
    fall = (F.col(value) - F.col("other")) / F.col("reach")
    down = cells.join(neighbours(cells, value), ["x", "y"]).withColumn("fall", fall).where("fall > 0")
    return down.groupBy("x", "y").agg(F.max_by("slot", F.struct("fall", -F.col("slot"))).alias("slot"), F.max("fall").alias("fall"))


def slope_normal(cells: DataFrame, metres: float = 1.0, value: str = "h") -> DataFrame:
    """Unit surface normals by central differences, one-sided at edges and holes."""
    near = neighbours(cells, value).where("slot < 4").groupBy("x", "y").agg(*(F.max(F.when(F.col("slot") == k, F.col("other"))).alias(f"n{k}") for k in range(4)))
    here = F.col(value)

    def difference(low: str, high: str):
        span = F.col(low).isNotNull().cast("int") + F.col(high).isNotNull().cast("int")
        return F.coalesce(F.try_divide(F.coalesce(F.col(high), here) - F.coalesce(F.col(low), here), span * metres), F.lit(0.0))

    g = cells.join(near, ["x", "y"], "left").select("x", "y", difference("n0", "n1").alias("gx"), difference("n2", "n3").alias("gy"))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    return g.select("x", "y", (-F.col("gx") / size).alias("nx"), (1 / size).alias("ny"), (-F.col("gy") / size).alias("nz"))


# --- grids as arrays -------------------------------------------------------


def _around(shape: tuple[int, int], r: int, c: int):
    for dx, dy in NEIGHBOURS:
        if 0 <= r + dy < shape[0] and 0 <= c + dx < shape[1]:
            yield dx, dy, r + dy, c + dx


def flood(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(filled, receiver as flat index or -1, order): standing water from the edge inward, lowest first, ties by index."""
    rows, cols = h.shape
    filled, tree, order = h.copy(), np.full(h.shape, -1), []
    seen = np.zeros(h.shape, bool)
    seen[[0, -1]] = seen[:, [0, -1]] = True
    heap = [(h[r, c], r * cols + c) for r, c in zip(*np.nonzero(seen), strict=True)]
    heapq.heapify(heap)
    while heap:
        _, at = heapq.heappop(heap)
        r, c = divmod(at, cols)
        order.append((r, c))
        for _, _, i, j in _around(h.shape, r, c):
            if not seen[i, j]:
                seen[i, j], filled[i, j], tree[i, j] = True, max(h[i, j], filled[r, c]), at
                heapq.heappush(heap, (filled[i, j], i * cols + j))
    to = tree.copy()
    for r in range(rows):
        for c in range(cols):
            best = max((((filled[r, c] - filled[i, j]) / _reach(dx, dy), -k, i * cols + j) for k, (dx, dy, i, j) in enumerate(_around(h.shape, r, c))), default=(0, 0, -1))
            if best[0] > 0:
                to[r, c] = best[2]
    return filled, to, order


def accumulate(filled: np.ndarray, to: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Cells that drain through each one: shared among all lower neighbours by fall ** 1.1 / reach; flats follow the flood."""
    area = np.ones(filled.shape)
    for r, c in reversed(order):
        share = {(i, j): ((filled[r, c] - filled[i, j]) / _reach(dx, dy)) ** SPREAD / _reach(dx, dy) for dx, dy, i, j in _around(filled.shape, r, c) if filled[i, j] < filled[r, c]}
        total = sum(share.values())
        if total:
            for k, s in share.items():
                area[k] += area[r, c] * s / total
        elif to[r, c] >= 0:
            area[divmod(to[r, c], filled.shape[1])] += area[r, c]
    return area


def incise(h: np.ndarray, rounds: int, rate: float, exponent: float = 0.5) -> np.ndarray:
    """Stream-power incision: an implicit sweep from the outlets up; ground never rises."""
    h = h.copy()
    for _ in range(rounds):
        filled, to, order = flood(h)
        area = accumulate(filled, to, order)
        for r, c in order:
            if to[r, c] >= 0:
                i, j = divmod(to[r, c], h.shape[1])
                k = rate * area[r, c] ** exponent
                h[r, c] = min(h[r, c], (h[r, c] + k * h[i, j]) / (1 + k)) if h[i, j] < h[r, c] else h[r, c]
    return h


def droplets(h: np.ndarray, n: int, seed: int = 1, steps: int = 64, erode: float = 0.3, settle: float = 0.3, capacity: float = 4.0) -> np.ndarray:
    """Droplet erosion, one drop after another; what a drop carries is put down where it ends, so mass is kept."""
    rng, h = np.random.default_rng(seed), h.astype(float)
    for _ in range(n):
        r, c, load = int(rng.integers(h.shape[0])), int(rng.integers(h.shape[1])), 0.0
        for _ in range(steps):
            low = min(((h[i, j], i, j) for _, _, i, j in _around(h.shape, r, c)), default=None)
            if low is None or low[0] >= h[r, c]:
                break
            drop = h[r, c] - low[0]
            change = (erode if capacity * drop > load else settle) * (capacity * drop - load)
            change = min(max(change, -load), drop / 2)
            h[r, c] -= change
            load += change
            r, c = low[1], low[2]
        h[r, c] += load
    return h


def on_grids(cells: DataFrame, kernel, result: str, key: str = "grid", value: str = "h", empty: float | None = None) -> DataFrame:
    """Run a kernel on each group's dense grid: kernel(array) -> dict of arrays; rows of (key, x, y, columns of ``result``).

    Cells that a group lacks count as ``empty``, or as its lowest.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = rows["x"].min(), rows["y"].min()
        grid = np.full((rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1), float(rows[value].min()) if empty is None else empty)
        grid[rows["y"] - y0, rows["x"] - x0] = rows[value]
        out = kernel(grid)
        r, c = np.indices(grid.shape).reshape(2, -1)
        return pd.DataFrame({key: rows[key].iloc[0], "x": c + x0, "y": r + y0} | {k: np.asarray(v).ravel() for k, v in out.items()})

    return cells.groupBy(key).applyInPandas(run, f"{key} long, x long, y long, {result}")


def drainage(cells: DataFrame, key: str = "grid") -> DataFrame:
    """filled, receiver and area of every cell of each grid; empty cells of a grid count as its lowest."""

    def kernel(h: np.ndarray) -> dict:
        filled, to, order = flood(h)
        area = accumulate(filled, to, order)
        return {"filled": filled, "receiver": to, "area": area, "flow": np.log2(area)}

    return on_grids(cells, kernel, "filled double, receiver long, area double, flow double", key)
