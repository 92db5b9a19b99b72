"""The fractal noises of ``noise`` over Arrow batches: the same numbers, for many octaves, where nested lambdas run uncompiled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import noise


def _mix(bits: np.ndarray) -> np.ndarray:
    bits = bits ^ (bits >> np.uint32(16))
    bits = bits * np.uint32(noise.MIX[0])
    bits = bits ^ (bits >> np.uint32(15))
    bits = bits * np.uint32(noise.MIX[1])
    return bits ^ (bits >> np.uint32(16))


def lattice_hash(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    word = lambda v: (v & 0xFFFFFFFF).astype(np.uint32)
    return _mix(_mix(np.uint32(seed * noise.SEED & 0xFFFFFFFF) ^ word(x) * np.uint32(noise.X)) ^ word(y) * np.uint32(noise.Y))


def gradient(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0

    def corner(dx: int, dy: int) -> np.ndarray:
        turn = (lattice_hash(x0 + dx, y0 + dy, seed) % np.uint32(noise.GRADIENTS)) * (2 * math.pi / noise.GRADIENTS)
        return np.cos(turn) * (fx - dx) + np.sin(turn) * (fy - dy)

    tx, ty = noise.fade(fx), noise.fade(fy)
    return noise.lerp(noise.lerp(corner(0, 0), corner(1, 0), tx), noise.lerp(corner(0, 1), corner(1, 1), tx), ty) * math.sqrt(2)


def summed(kind: str, x: np.ndarray, y: np.ndarray, seed: int, f: noise.Fractal) -> np.ndarray:
    """fbm, billow or ridged noise of arrays of places."""
    out, weight, scale = np.zeros(len(x)), np.ones(len(x)), 1.0
    for k, q in enumerate(f.frequencies):
        part = gradient(x * q, y * q, seed ^ (k * noise.OCTAVE[kind] & 0xFFFFFFFF))
        if kind == "billow":
            part = np.abs(part)
        elif kind == "ridged":
            part = (1 - np.abs(part)) ** 2 * weight
            weight = np.clip(part * 2, 0, 1)
        out += part * scale
        scale *= noise.GAIN
    out /= f.total
    return out if kind == "fbm" else np.minimum(out, 1.0)


def column(kind: str, x: Column, y: Column, seed: int, f: noise.Fractal) -> Column:
    """Noise of a place; null if a coordinate is null or not finite."""

    @F.pandas_udf("double")
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.to_numpy(float), y.to_numpy(float)
        known = np.isfinite(a) & np.isfinite(b)
        out = summed(kind, np.where(known, a, 0.0), np.where(known, b, 0.0), seed, f)
        return pd.Series(np.where(known, out, np.nan)).astype("Float64").mask(~known)

    return batch(x, y)
