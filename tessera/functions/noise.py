"""Lattice hashes, interpolants, fractal noise and ordered dither, as Column expressions in double precision.

32-bit words live in BIGINT columns; products are formed from 16-bit halves,
so that nothing overflows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIX = (0x7FEB352D, 0x846CA68B)
SEED, X, Y = 0x9E3779B1, 0x3504F333, 0xF1BBCDCB
OCTAVE = {"fbm": 0x51ED270B, "ridged": 0x68E31DA4, "billow": 0x1B56C4E9}
WARP = (0x2F9EC1A7, 0xB5A371D5)
LACUNARITY, GAIN, MOST_OCTAVES = 2.017, 0.5, 12
GRADIENTS = 16

_WORD = 0xFFFFFFFF


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def times(a: Column, c: int) -> Column:
    """a * c modulo 2**32 for a in [0, 2**32)."""
    return (a * (c & 0xFFFF) + F.shiftleft((a * (c >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(_WORD))


def mix(bits: Column) -> Column:
    down = lambda n: lambda b: b.bitwiseXOR(F.shiftrightunsigned(b, n))
    scaled = lambda c: lambda b: times(b, c)
    for f in (down(16), scaled(MIX[0]), down(15), scaled(MIX[1]), down(16)):
        bits = let(bits, f)
    return bits


def lattice_hash(x: Column, y: Column, seed: int) -> Column:
    """A repeatable word for a lattice point."""
    word = lambda v, c: let(v.cast("long").bitwiseAND(F.lit(_WORD)), lambda w: times(w, c))
    start = F.lit(seed * SEED & _WORD).cast("long")
    return mix(mix(start.bitwiseXOR(word(x, X))).bitwiseXOR(word(y, Y)))


def hash_unit(x: Column, y: Column, seed: int) -> Column:
    """In [0, 1), from the upper 24 bits."""
    return F.shiftrightunsigned(lattice_hash(x, y, seed), 8) / F.lit(16777216.0)


def fade(t: Column) -> Column:
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def smoothstep(low: float, high: float, at: Column) -> Column:
    t = F.least(F.greatest((at - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - 2.0 * t)


def _square(x: Column, y: Column, corner) -> Column:
    """Faded interpolation of corner(ix, iy, x offset, y offset) over a lattice square."""

    def inside(p: Column) -> Column:
        at = lambda dx, dy: corner(p["x0"] + dx, p["y0"] + dy, p["fx"] - float(dx), p["fy"] - float(dy))
        return lerp(lerp(at(0, 0), at(1, 0), fade(p["fx"])), lerp(at(0, 1), at(1, 1), fade(p["fx"])), fade(p["fy"]))

    whole = lambda c: F.struct(F.floor(c["x"]).alias("x0"), F.floor(c["y"]).alias("y0"), (c["x"] - F.floor(c["x"])).alias("fx"), (c["y"] - F.floor(c["y"])).alias("fy"))
    return let(let(F.struct(x.alias("x"), y.alias("y")), whole), inside)


def gradient(x: Column, y: Column, seed: int) -> Column:
    """Gradient noise in [-1, 1], zero on the lattice; one of 16 directions a point."""

    def corner(ix: Column, iy: Column, ox: Column, oy: Column) -> Column:
        turn = F.pmod(lattice_hash(ix, iy, seed), F.lit(GRADIENTS)) * (2 * math.pi / GRADIENTS)
        return let(turn, lambda a: F.cos(a) * ox + F.sin(a) * oy)

    return _square(x, y, corner) * math.sqrt(2)


def value(x: Column, y: Column, seed: int) -> Column:
    """Value noise in [-1, 1]."""
    return _square(x, y, lambda ix, iy, ox, oy: hash_unit(ix, iy, seed) * 2.0 - 1.0)


@dataclass(frozen=True)
class Fractal:
    wavelength: float
    octaves: int
    summed: int | None = None  # how many of them; the scale stays that of all

    @property
    def frequencies(self) -> list[float]:
        n = self.octaves if self.summed is None else self.summed
        return [LACUNARITY**k / self.wavelength for k in range(min(n, MOST_OCTAVES))]

    @property
    def total(self) -> float:
        return sum(GAIN**k for k in range(self.octaves)) or 1.0

    def band_limited(self, wavelength: float) -> Fractal:
        """Without the octaves finer than a wavelength."""
        n = 0
        while n < self.octaves and self.wavelength / LACUNARITY**n >= wavelength:
            n += 1
        return Fractal(self.wavelength, self.octaves, n)


def _octaves(x: Column, y: Column, seed: int, f: Fractal, kind: str) -> list[Column]:
    return [gradient(x * q, y * q, seed ^ (k * OCTAVE[kind] & _WORD)) for k, q in enumerate(f.frequencies)]


def _sum(parts: list[Column], f: Fractal) -> Column:
    return reduce(lambda a, b: a + b, (p * GAIN**k for k, p in enumerate(parts)), F.lit(0.0)) / f.total


def fbm(x: Column, y: Column, seed: int, f: Fractal) -> Column:
    return _sum(_octaves(x, y, seed, f, "fbm"), f)


def billow(x: Column, y: Column, seed: int, f: Fractal) -> Column:
    return F.least(_sum([F.abs(p) for p in _octaves(x, y, seed, f, "billow")], f), F.lit(1.0))


def ridged(x: Column, y: Column, seed: int, f: Fractal) -> Column:
    """Creases, each octave weighted by the one above it: a fold over the octaves' array, so that none is written twice."""
    parts = _octaves(x, y, seed, f, "ridged")
    if not parts:
        return F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("sum"))

    def step(acc: Column, raw: Column) -> Column:
        signal = F.pow(1.0 - F.abs(raw), F.lit(2.0)) * acc["weight"]
        return F.struct(F.least(F.greatest(signal * 2.0, F.lit(0.0)), F.lit(1.0)).alias("weight"), (acc["scale"] * GAIN).alias("scale"), (acc["sum"] + signal * acc["scale"]).alias("sum"))

    return F.least(F.aggregate(F.array(*parts), start, step, lambda a: a["sum"]) / f.total, F.lit(1.0))


def warp(x: Column, y: Column, seed: int, f: Fractal, amount: float) -> tuple[Column, Column]:
    return x + fbm(x, y, seed ^ WARP[0], f) * amount, y + fbm(x, y, seed ^ WARP[1], f) * amount


def bayer_rank(x: Column, y: Column, bits: int = 3) -> Column:
    """Rank in the ordered dither matrix of side 2**bits, from interleaved bits of x ^ y and y."""
    out = F.lit(0)
    for k in range(bits):
        bit = lambda v, k=k: F.shiftright(v.cast("int"), k).bitwiseAND(1)
        out = out + F.shiftleft(bit(x).bitwiseXOR(bit(y)), 2 * (bits - 1 - k) + 1) + F.shiftleft(bit(y), 2 * (bits - 1 - k))
    return out
