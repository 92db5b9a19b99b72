"""Rays against a height field, by descent through its max pyramid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Largest height field, in cells, that is sent to every task.
MOST_CELLS = 16_000_000
NUDGE = 1e-9


def bounds_of(h: np.ndarray) -> list[np.ndarray]:
    """Maxima of closed squares, then of 2 x 2 of them; a square with a hole (NaN) at a corner has no ground."""
    m = [np.maximum(np.maximum(h[:-1, :-1], h[1:, :-1]), np.maximum(h[:-1, 1:], h[1:, 1:]))]
    m[0] = np.where(np.isnan(m[0]), -np.inf, m[0])
    while max(m[-1].shape) > 1:
        a = m[-1]
        a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), constant_values=-np.inf)
        m.append(np.maximum(np.maximum(a[::2, ::2], a[1::2, ::2]), np.maximum(a[::2, 1::2], a[1::2, 1::2])))
    return m


def surface(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear height; NaN where a corner is a hole.  Places outside count as the edge."""
    x, y = np.clip(x, 0, h.shape[1] - 1), np.clip(y, 0, h.shape[0] - 1)
    c, r = np.minimum(x.astype(int), h.shape[1] - 2), np.minimum(y.astype(int), h.shape[0] - 2)
    fx, fy = x - c, y - r
    return (h[r, c] * (1 - fx) + h[r, c + 1] * fx) * (1 - fy) + (h[r + 1, c] * (1 - fx) + h[r + 1, c + 1] * fx) * fy


def march(h: np.ndarray, m: list[np.ndarray], o: np.ndarray, d: np.ndarray, budget: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(outcome, distance) of rays (rows of x, y, height in cell units), all at once.

    Outcomes: hit; none; abandoned, if a ray meets the field's box under ground;
    spent, beyond ``budget`` steps.  A cell whose bound the ray stays above is
    crossed in one step; otherwise the next finer one is looked at; in the
    finest the crossing is bisected.  Nothing is met inside a hole; a ray that
    sinks under its rim hits where the ground begins again.  A ray straight up
    or down is one comparison with the surface.
    """
    outcome, distance = np.full(len(o), "spent", object), np.full(len(o), np.nan)
    top = np.array([h.shape[1] - 1, h.shape[0] - 1], float)
    moving = d[:, :2] != 0
    step = np.where(moving, d[:, :2], 1.0)
    a, b = -o[:, :2] / step, (top - o[:, :2]) / step
    near = np.maximum(0, np.where(moving, np.minimum(a, b), -np.inf).max(1))
    far = np.where(moving, np.maximum(a, b), np.inf).min(1)
    inside = (moving | ((o[:, :2] >= 0) & (o[:, :2] <= top))).all(1) & (near < far)
    below = lambda k, s: (o[k, 2] + d[k, 2] * s) <= surface(h, o[k, 0] + d[k, 0] * s, o[k, 1] + d[k, 1] * s)
    outcome[~inside] = "none"
    under = np.zeros(len(o), bool)
    at = np.flatnonzero(inside)
    under[at] = o[at, 2] + d[at, 2] * near[at] < surface(h, o[at, 0] + d[at, 0] * near[at], o[at, 1] + d[at, 1] * near[at])
    outcome[under] = "abandoned"
    plumb = inside & ~under & ~moving.any(1)
    ground = surface(h, o[plumb, 0], o[plumb, 1])
    lands = (d[plumb, 2] < 0) & ~np.isnan(ground)
    outcome[plumb] = np.where(lands, "hit", "none")
    distance[plumb] = np.where(lands, (ground - o[plumb, 2]) / np.where(lands, d[plumb, 2], 1.0), np.nan)

    wide, high = np.array([x.shape[1] for x in m]), np.array([x.shape[0] for x in m])
    flat, first = np.concatenate([x.ravel() for x in m]), np.cumsum([0] + [x.size for x in m[:-1]])
    act = np.flatnonzero(inside & ~under & moving.any(1))
    t, level = near.copy(), np.full(len(o), len(m) - 1)
    for _ in range(budget):
        gone = t[act] >= far[act]
        outcome[act[gone]] = "none"
        act = act[~gone]
        if not len(act):
            break
        now, lev = t[act], level[act]
        size = 1 << lev
        cell = ((o[act, :2] + d[act, :2] * (now + NUDGE)[:, None]) // size[:, None]).astype(int)
        cell = np.clip(cell, 0, np.stack((wide[lev], high[lev]), 1) - 1)
        edge = (cell + (d[act, :2] > 0)) * size[:, None]
        out = np.where(moving[act], np.maximum((edge - o[act, :2]) / step[act], now[:, None]), np.inf).min(1)
        out = np.minimum(out, far[act])
        clear = np.minimum(o[act, 2] + d[act, 2] * now, o[act, 2] + d[act, 2] * out) > flat[first[lev] + cell[:, 1] * wide[lev] + cell[:, 0]]
        t[act[clear]], level[act[clear]] = out[clear] + NUDGE, np.minimum(lev[clear] + 1, len(m) - 1)
        level[act[~clear & (lev > 0)]] -= 1
        look = ~clear & (lev == 0)
        if not look.any():
            continue
        k, lo, hi = act[look], now[look], out[look]
        probes = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 9)
        hits = np.stack([below(k, probes[:, i]) for i in range(9)], 1)
        some, which = hits.any(1), hits.argmax(1)
        t[k[~some]], level[k[~some]] = hi[~some] + NUDGE, min(1, len(m) - 1)
        k, which, rows = k[some], which[some], np.flatnonzero(some)
        lo, hi = probes[rows, np.maximum(which - 1, 0)], probes[rows, which]
        for _ in range(40):
            mid = (lo + hi) / 2
            on = below(k, mid)
            lo, hi = np.where(on, lo, mid), np.where(on, mid, hi)
        outcome[k], distance[k] = "hit", hi
        act = np.setdiff1d(act, k, assume_unique=True)
    return outcome, distance


def cast(rays: DataFrame, h: np.ndarray) -> DataFrame:
    """ray, outcome, distance of rays (ray, ox, oy, oz, dx, dy, dz) against one height field of a checked size; holes are NaN."""
    if h.size > MOST_CELLS:
        raise ValueError("the height field is too large to send to every task; cut it and cast rays by tile")
    shared = rays.sparkSession.sparkContext.broadcast((h, bounds_of(h)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, m = shared.value
        for p in parts:
            outcome, distance = march(field, m, p[["ox", "oy", "oz"]].to_numpy(float), p[["dx", "dy", "dz"]].to_numpy(float))
            yield pd.DataFrame({"ray": p["ray"], "outcome": outcome, "distance": distance})

    return rays.mapInPandas(run, "ray long, outcome string, distance double")
