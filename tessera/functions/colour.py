"""Linear-light colour and shading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srgb_to_linear(byte: Column) -> Column:
    v = byte / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """To a byte, halves away from zero, clamped."""
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return F.least(F.greatest(F.round(s * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")


def lambert(linear: Column, facing: Column) -> Column:
    """Ambient plus what the sun adds to a surface that faces it by a cosine."""
    return linear * (0.35 + 0.65 * F.greatest(facing, F.lit(0.0)))


def pack_offset(ident: Column, ox: Column, oy: Column) -> Column:
    return ident.bitwiseOR(F.shiftleft(ox, 16)).bitwiseOR(F.shiftleft(oy, 24))


def unpack_offset(word: Column) -> tuple[Column, Column, Column]:
    return word.bitwiseAND(0xFFFF), F.shiftright(word, 16).bitwiseAND(0xFF), F.shiftright(word, 24).bitwiseAND(0xFF)
