"""Column expressions of the voxel grid: exact float32 arithmetic, quantisation, Morton order and label colours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 21 bits for each axis, centred on zero.
HALF = 1 << 20
#: The 27 cells around a voxel; dz is the outer loop and dx the inner one.
OFFSETS = [(dx, dy, dz) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: The own cell and the 13 that follow it in the order above: each unordered pair of cells once.
HALF_OFFSETS = OFFSETS[13:]
GOLDEN = 0.6180339887498948


def check_parameters(eps: float, min_pts: int) -> None:
    if not math.isfinite(eps) or eps <= 0:
        raise ValueError("epsilon must be finite and greater than 0")
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")


def f32(value: float) -> Column:
    return F.lit(float(np.float32(value))).cast("float")


def cell_scale(eps: float) -> np.float32:
    """Cells per unit of length: just under 1/eps, so that points at a distance of exactly eps stay in adjacent cells."""
    return np.nextafter(np.float32(1.0) / np.float32(eps), np.float32(0))


def squared_radius(eps: float) -> float:
    return float(np.float32(eps) * np.float32(eps))


def voxel_coordinate(coordinate: str | Column, eps: float) -> Column:
    """The cell index of a finite float32 coordinate; clamped before the cast, which would overflow under ANSI."""
    c = F.col(coordinate) if isinstance(coordinate, str) else coordinate
    scaled = c.cast("float") * f32(float(cell_scale(eps)))
    return F.floor(F.greatest(f32(-HALF), F.least(f32(HALF - 1), scaled))).cast("int")


def _spread(v: Column) -> Column:
    """Move the 21 low bits of ``v`` to every third bit."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(vx: str = "vx", vy: str = "vy", vz: str = "vz") -> Column:
    x, y, z = (_spread(F.col(c).cast("long") + F.lit(HALF).cast("long")) for c in (vx, vy, vz))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def squared_distance(a: str, b: str) -> Column:
    """Left to right in float32; neither pow nor sqrt, which would widen to double."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def is_finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        c = F.col(n).cast("float")
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")).cast("float"))
    return F.coalesce(ok, F.lit(False))


def _sector(hue: Column, s: Column, v: Column, one: Column, number) -> list[Column]:
    """Red, green and blue in 0..1 for a hue in sixths of the circle."""
    whole = F.floor(hue)
    f = hue - whole.cast(number)
    p, q, t = v * (one - s), v * (one - s * f), v * (one - s * (one - f))
    table = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    out = []
    for channel in range(3):
        c = F.when(whole == 0, table[0][channel])
        for k in range(1, 5):
            c = c.when(whole == k, table[k][channel])
        out.append(c.otherwise(table[5][channel]))
    return out


def label_color(label: str = "label") -> Column:
    """Output colour: grey for noise, else golden-ratio hues at saturation 0.75 and value 0.95, all in float32."""
    turn = (F.col(label).cast("float") * f32(GOLDEN)) % f32(1)
    hue = turn * f32(360) / f32(60)
    rgb = _sector(hue, f32(0.75), f32(0.95), f32(1), "float")
    named = [F.when(F.col(label) == 0, F.lit(96)).otherwise(F.round(F.greatest(f32(0), F.least(f32(255), c * f32(255)))).cast("int")).cast("smallint").alias(n) for n, c in zip("rgb", rgb, strict=True)]
    return F.struct(*named)


def scene_color(label: str = "label") -> Column:
    """Colour of generated scenes: grey for negative labels, value 0.90, double precision, rounding half to even."""
    hue = F.pmod(F.col(label).cast("double") * F.lit(GOLDEN), F.lit(1.0)) * F.lit(6.0)
    rgb = _sector(hue, F.lit(0.75), F.lit(0.90), F.lit(1.0), "double")
    named = [F.when(F.col(label) < 0, F.lit(128)).otherwise(F.rint(c * F.lit(255.0)).cast("int")).cast("smallint").alias(n) for n, c in zip("rgb", rgb, strict=True)]
    return F.struct(*named)
