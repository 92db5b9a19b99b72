"""Detail on a coarse landscape: heights between its cells, and what covers the ground there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batch_noise, noise
from .ground import CHANNEL_FLOW
from .materials import ID

# Shares of the relief at which trees and snow set in, how far noise and sun move them, and the bands around them.
TREELINE, SNOWLINE = 0.52, 0.76
LINE_SHARE, ASPECT_SHARE = 0.05, 0.063
KRUMMHOLZ_SHARE, ROCK_BAND_SHARE = 0.137, 0.079
ICE_STEEPNESS = 0.45
ROCK_WOODED, ROCK_ALPINE = 0.86, 0.42
SCREE_STEEPNESS, SCREE_FILLING = 0.30, 0.22
# Wavelength, octaves and seed of each noise; metres of each relief.
WOBBLE, WOBBLE_SEED = noise.Fractal(2600.0, 3), 0x4B19C2E7
MOTTLE, MOTTLE_SEED = noise.Fractal(140.0, 4), 0xA71F63B9
TEXTURE, TEXTURE_SEED, TEXTURE_METRES = noise.Fractal(512.0, 10), 0x7C1A3F55, 5.0
RIB, RIB_SEED, RIB_METRES = noise.Fractal(380.0, 6), 0x2B90D417, 15.0
MORAINE, MORAINE_SEED, MORAINE_METRES = noise.Fractal(220.0, 4), 0x9D5486E1, 6.0
CHANNEL_METRES = 4.0


def unevenness(x: Column, y: Column, texel: float, seed: int) -> tuple[Column, Column]:
    """(wobble, mottle) at raster metres; the mottle has no octave finer than two texels."""
    return batch_noise.column("fbm", x, y, seed ^ WOBBLE_SEED, WOBBLE), batch_noise.column("fbm", x, y, seed ^ MOTTLE_SEED, MOTTLE.band_limited(2 * texel))


def reliefs(x: Column, y: Column, texel: float, seed: int) -> tuple[Column, Column, Column]:
    """(texture, ribs, moraine) at raster metres, the latter two centred, none finer than two texels."""
    finest = 2 * texel
    return (
        batch_noise.column("fbm", x, y, seed ^ TEXTURE_SEED, TEXTURE.band_limited(finest)),
        batch_noise.column("ridged", x, y, seed ^ RIB_SEED, RIB.band_limited(finest)) - 0.5,
        batch_noise.column("billow", x, y, seed ^ MORAINE_SEED, MORAINE.band_limited(finest)) - 0.5,
    )


def detail_height(height: Column, filled: Column, ground: dict[str, Column], texture: Column, ribs: Column, moraine: Column) -> Column:
    """Rough where it is steep, ribbed where it is rocky, hummocky where it is filled, cut by channels, level under lakes."""
    steep, filling = ground["steepness"], ground["filling"]
    land = height + texture * TEXTURE_METRES * (0.25 + 1.5 * steep) * (1 - 0.7 * filling)
    land = land + ribs * RIB_METRES * ground["rockiness"] * (1 - filling) + moraine * MORAINE_METRES * filling * (1 - steep)
    return noise.lerp(land - ground["channel"] * CHANNEL_METRES, filled, ground["lake"])


@dataclass(frozen=True)
class Place:
    """A texel as the rules see it; ``south`` is the southward share of its downhill direction."""

    height: Column
    slope: Column
    south: Column
    flow: Column
    hardness: Column
    wobble: Column
    mottle: Column


def material(p: Place, ground: dict[str, Column], valley: float, peak: float) -> Column:
    """Id of the cover: the first rule that holds, from water over ice and rock to what grows.

    Every height is a share of the relief between ``valley`` and ``peak``, which
    must differ.  A null in any input falls through to the rules that do not ask
    for it.
    """
    if peak <= valley:
        raise ValueError(f"relief from {valley} to {peak}")
    span = peak - valley
    steep, filling, channel, lake = ground["steepness"], ground["filling"], ground["channel"], ground["lake"]
    shift, sun = p.wobble * LINE_SHARE, p.south * steep * ASPECT_SHARE
    trees, snow = valley + span * (TREELINE + shift + sun), valley + span * (SNOWLINE + shift * 0.6 + sun * 1.2)
    nudge = p.mottle * (span * LINE_SHARE)
    above, band = p.height > trees, F.least(F.greatest((p.height - valley) / max(span, 1.0), F.lit(0.0)), F.lit(1.0))
    step = lambda low, high, at: noise.smoothstep(low, high, at)
    rock = noise.lerp(F.lit(ROCK_WOODED), F.lit(ROCK_ALPINE), step(trees - span * ROCK_BAND_SHARE, trees + span * ROCK_BAND_SHARE, p.height))
    wet = (lake > 0.12) | ((p.slope < 0.035) & (p.flow > CHANNEL_FLOW - 2.5) & (filling > 0.25))
    # The snow line can meet the tree line on a face turned far from the sun; the step between them is then a cliff.
    gap = F.nullif(snow - trees, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce((p.height + nudge - trees) / gap, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    barren = t * t * (3 - 2 * t)
    valley_floor = (p.slope < 0.09) & (band < 0.35)
    low = band < 0.30 + p.mottle * 0.08
    rules = [
        ("Lake", lake > 0.5),
        ("River", channel > 0.62),
        ("Stream", channel > 0.28),
        ("Bog", wet & above),
        ("Marsh", wet),
        ("Glacier", (p.height > snow + nudge) & (steep < ICE_STEEPNESS)),
        ("BareRock", ground["rockiness"] > rock + p.mottle * 0.10),
        ("Scree", (steep > SCREE_STEEPNESS) & (filling > SCREE_FILLING)),
        ("Fell", above & (barren > 0.55)),
        ("Heath", above & ((steep > 0.25) | (p.hardness > 0.6))),
        ("Grassland", above),
        # Cut banks need a slope that no valley floor has, so there is no rule for them.
        ("Shingle", valley_floor & (channel > 0.04) & (filling > 0.45)),
        ("Sand", valley_floor & (filling > 0.7) & (p.mottle > 0.45)),
        ("Meadow", valley_floor & (p.mottle > 0.15)),
        ("Grassland", valley_floor),
        ("Scrub", step(trees - span * KRUMMHOLZ_SHARE, trees, p.height + nudge * 0.75) > 0.6),
        ("ForestBroadleaved", low & (p.flow > CHANNEL_FLOW - 3.5) & (steep < 0.3)),
        ("ForestMixed", low & ((p.south > 0.25) | (p.mottle > 0.25))),
    ]
    first = F.coalesce(*(F.when(holds, F.lit(ID[name])) for name, holds in rules))
    return F.coalesce(first, F.lit(ID["ForestNeedleleaved"]))
