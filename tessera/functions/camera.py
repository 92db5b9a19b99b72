"""Orientations and lenses: headings to quaternions and back, the rays of a screen, reversed depth without a far plane.

East is +x, up +y, north -z.  Yaw turns right, pitch raises the nose and roll
drops the right wing; they apply in this order, each about the axes left by the
one before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field of view, near plane, clearance above the highest point as a share of the longer side.
FOV_Y, NEAR, CLEARANCE = math.radians(60.0), 1.0, 0.08

Vector = tuple[Column, Column, Column]


def quaternion(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Struct (x, y, z, w)."""
    (sy, cy), (sx, cx), (sz, cz) = ((F.sin(a / 2), F.cos(a / 2)) for a in (-yaw, pitch, -roll))
    return F.struct(
        (cy * sx * cz + sy * cx * sz).alias("x"), (sy * cx * cz - cy * sx * sz).alias("y"),
        (cy * cx * sz - sy * sx * cz).alias("z"), (cy * cx * cz + sy * sx * sz).alias("w"),
    )


def axes(q: Column) -> tuple[Vector, Vector, Vector]:
    """Where a unit quaternion takes x, y and z: right, up and backward."""
    x, y, z, w = (q[k] for k in "xyzw")
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    )


def angles(q: Column) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll); straight up or down, where yaw and roll turn about one axis, all of the turn is yaw."""
    right, up, back = axes(q)
    sine = F.least(F.greatest(-back[1], F.lit(-1.0)), F.lit(1.0))
    pole = F.abs(sine) > 1 - 1e-12
    yaw = F.when(pole, -F.atan2(-right[2], right[0])).otherwise(-F.atan2(back[0], back[2]))
    return yaw, F.asin(sine), F.when(pole, F.lit(0.0)).otherwise(-F.atan2(right[1], up[1]))


def ray_basis(q: Column, aspect: Column, fov_y: float = FOV_Y) -> tuple[Vector, Vector, Vector]:
    """Right, up and forward: a place (u, v) of the screen, each from -1 to 1, looks along u * right + v * up + forward."""
    half = math.tan(fov_y / 2)
    right, up, back = axes(q)
    return tuple(r * half * aspect for r in right), tuple(u * half for u in up), tuple(-b for b in back)


def to_view(q: Column, eye: Vector, point: Vector) -> Vector:
    """A point of the world in the camera's axes; the camera looks along -z."""
    rel = [p - e for p, e in zip(point, eye, strict=True)]
    return tuple(a[0] * rel[0] + a[1] * rel[1] + a[2] * rel[2] for a in axes(q))


def to_clip(seen: Vector, aspect: Column, fov_y: float = FOV_Y, near: float = NEAR) -> tuple[Column, Column, Column, Column]:
    """Clip space: over its last component, depth is 1 at the near plane and 0 at infinity."""
    zoom = 1 / math.tan(fov_y / 2)
    return seen[0] * zoom / aspect, seen[1] * zoom, F.lit(near), -seen[2]


def overlooking(width: Column, depth: Column, highest: Column) -> tuple[Vector, Column]:
    """Eye and pitch of a view from the southern edge that has the far edge in sight; yaw and roll are none."""
    up = highest + CLEARANCE * F.greatest(width, depth)
    return (F.lit(0.0), up, depth * 0.5), -F.atan(up / F.greatest(depth, F.lit(2.0**-23)))
