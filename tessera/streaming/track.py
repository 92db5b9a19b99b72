"""Keyed state over a stream of camera positions: tile residency and smoothed metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TILES, LEVELS, BUDGET = 4, 3, 16
#: Rows that are averaged and handed on at once.
PIECE = 10000


def wanted(x: float, y: float, level: int, tiles: int = TILES) -> list[tuple[int, int, int]]:
    """(level, tx, ty) of the square of tiles around a position, nearest to its middle first."""
    span = 512 << level
    cx, cy = math.floor(x / span), math.floor(-y / span)
    square = [(cx + i - tiles // 2, cy + j - tiles // 2) for i in range(tiles) for j in range(tiles)]
    square.sort(key=lambda t: (max(abs(t[0] - cx), abs(t[1] - cy)), t[1], t[0]))
    return [(level, *t) for t in square]


def advance(held: set, x: float, y: float, budget: int = BUDGET, levels: int = LEVELS) -> tuple[set, list[tuple[int, int, int]]]:
    """(tiles held after the move, tiles to load now): coarsest level first, at most ``budget`` a step."""
    want = [t for level in reversed(range(levels)) for t in wanted(x, y, level)]
    load = [t for t in want if t not in held][:budget]
    return (held & set(want)) | set(load), load


def settle(x: float, y: float, budget: int = BUDGET) -> set:
    """Advance in place until nothing is pending."""
    held: set = set()
    while True:
        held, load = advance(held, x, y, budget)
        if not load:
            return held


def residency(track: DataFrame, key: str = "user_id") -> DataFrame:
    """Tiles to load at every step of each key's track (key, seq, x, y), as key, seq, level, tx, ty; works on streams."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(t) for t in zip(*state.get, strict=True)} if state.exists else set()
        for p in parts:
            out = []
            for r in p.sort_values("seq").itertuples(index=False):
                held, load = advance(held, r.x, r.y)
                out += [(k[0], r.seq, *t) for t in load]
            yield pd.DataFrame(out, columns=[key, "seq", "level", "tx", "ty"])
        state.update(tuple(list(c) for c in zip(*sorted(held), strict=True)) if held else ([], [], []))

    return track.groupBy(key).applyInPandasWithState(run, f"{key} long, seq long, level int, tx int, ty int", "level array<int>, tx array<int>, ty array<int>", "append", GroupStateTimeout.NoTimeout)


def smoothed(metrics: DataFrame, key: str = "user_id", scale: float = 0.25) -> DataFrame:
    """Time-aware running averages (key, seconds, value -> key, seconds, smoothed), with state across batches.

    Rows of a key come in any order over chunks and files, so all that a batch has of it are put in order of time, ties by
    value, before the first is averaged.  Time never runs backwards: a row older than what an earlier batch ended with
    leaves the average as it is.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = zip(*((p["seconds"].to_numpy("float64"), p["value"].to_numpy("float64")) for p in parts), strict=True)
        seconds, value = (np.concatenate(c) for c in columns)
        order = np.lexsort((value, seconds))
        seconds, value = seconds[order], value[order]
        at = state.get if state.exists else None
        for i in range(0, len(seconds), PIECE):
            out = []
            for t, v in zip(seconds[i : i + PIECE].tolist(), value[i : i + PIECE].tolist(), strict=True):
                if at is not None:
                    v = at[1] + (1 - math.exp(min(at[0] - t, 0.0) / scale)) * (v - at[1])
                    t = max(at[0], t)
                at = (t, v)
                out.append(v)
            yield pd.DataFrame({key: k[0], "seconds": seconds[i : i + PIECE], "smoothed": out})
        if at is not None:
            state.update(at)

    return metrics.groupBy(key).applyInPandasWithState(run, f"{key} long, seconds double, smoothed double", "seconds double, value double", "append", GroupStateTimeout.NoTimeout)
