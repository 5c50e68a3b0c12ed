"""Distance anti-join: candidates that keep a distance from every occupied point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.exprs import OFFSETS, f32, squared_distance, squared_radius, voxel_coordinate
from pointweave.plans.lineage import shuffled


def far_candidates(candidates: DataFrame, occupied: DataFrame, distance: float) -> DataFrame:
    """Rows of ``candidates`` (point_id, x, y, z) whose nearest occupied point is at least ``distance`` away.

    Candidates probe the 27 cells around their own; occupied points are not repeated.  Null positions count as far.
    """
    cells = {f"v{c}": voxel_coordinate(c, distance) for c in "xyz"}
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "dz"), o, strict=True)]) for o in OFFSETS])
    point = F.struct("x", "y", "z")
    probes = candidates.withColumns(cells).select("point_id", point.alias("p"), "vx", "vy", "vz", F.explode(offsets).alias("o"))
    probes = probes.select("point_id", "p", *[(F.col(f"v{c}") + F.col(f"o.d{c}")).alias(f"v{c}") for c in "xyz"])
    there = occupied.withColumns(cells).select(point.alias("q"), "vx", "vy", "vz")
    close = probes.join(shuffled(there), ["vx", "vy", "vz"]).where(squared_distance("p", "q") < f32(squared_radius(distance))).select("point_id").distinct()
    return candidates.join(shuffled(close), "point_id", "left_anti")
