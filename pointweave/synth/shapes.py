"""Shapes as tables: a row range with random columns, so that a cluster of any size is generated in parallel."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.noise import far_candidates
from pointweave.operators.summary import bounding_box
from pointweave.plans.lineage import cut
from pointweave.synth.scene import Scene, draw, place_centres, points_for, rotation_matrix


class _Random:
    """Independent random columns from one seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        self.seed += 1
        return F.rand(self.seed) * (high - low) + low

    def normal(self) -> Column:
        self.seed += 1
        return F.randn(self.seed)


def _disk(df: DataFrame, radius: float, r: _Random) -> DataFrame:
    return df.withColumns({"_s": F.sqrt(r.uniform()) * radius, "_a": r.uniform(0, 2 * math.pi)}).withColumns({"_u": F.col("_s") * F.cos("_a"), "_v": F.col("_s") * F.sin("_a")})


def local_points(spark: SparkSession, kind: str, d: dict[str, float], n: int, eps: float, seed: int) -> DataFrame:
    """``n`` points ``x, y, z`` (double) of a shape around the origin."""
    r = _Random(seed * 1009)
    size = {k: v if k in ("arc_fraction", "aspect_ratio") else v * eps for k, v in d.items()}
    df = spark.range(n)
    if kind == "gaussian":
        df = df.withColumns({c: r.normal() * size["std"] for c in "xyz"})
    elif kind == "box":
        df = df.withColumns({c: r.uniform(-size[k] / 2, size[k] / 2) for c, k in zip("xyz", ("width", "height", "depth"), strict=True)})
    elif kind in ("tube", "cylinder"):
        length = size["length" if kind == "tube" else "height"]
        df = _disk(df, size["radius"], r).withColumns({"x": F.col("_u"), "y": F.col("_v"), "z": r.uniform(-length / 2, length / 2)})
    elif kind == "ball":
        df = df.withColumns({f"_{c}": r.normal() for c in "xyz"}).withColumn("_r", F.cbrt(r.uniform()) * size["radius"] / F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2))
        df = df.withColumns({c: F.col(f"_{c}") * F.col("_r") for c in "xyz"})
    elif kind == "crescent":
        df = _disk(df, size["thickness"] / 2, r).withColumn("_t", r.uniform(0, 2 * math.pi * size["arc_fraction"]))
        ring = F.lit(size["radius"]) + F.col("_u")
        df = df.withColumns({"x": ring * F.cos("_t"), "y": ring * F.sin("_t"), "z": F.col("_v")})
    elif kind == "torus":
        major, minor = size["major_radius"], size["major_radius"] / size["aspect_ratio"]
        # uniform in volume: angles are accepted in proportion to the distance from the axis; over-sample, then keep n
        wide = math.ceil(n * (major + minor) / major * 1.2) + 384
        df = _disk(spark.range(wide), minor, r).withColumns({"_t": r.uniform(0, 2 * math.pi), "_k": r.uniform(0, major + minor)})
        ring = F.lit(major) + F.col("_u")
        df = df.where(F.col("_k") <= ring).orderBy("id").limit(n).withColumns({"x": ring * F.cos("_t"), "y": ring * F.sin("_t"), "z": F.col("_v")})
    else:
        raise ValueError(f"unknown cluster type {kind!r}")
    return df.select("x", "y", "z")


def moved(df: DataFrame, matrix: np.ndarray, centre: np.ndarray) -> DataFrame:
    new = {c: sum((F.col(a) * float(matrix[k, m]) for m, a in enumerate("xyz")), F.lit(float(centre[k]))) for k, c in enumerate("xyz")}
    return df.select(*[e.alias(c) for c, e in new.items()])


def clusters(spark: SparkSession, scene: Scene) -> DataFrame:
    """``cluster`` (from 1) and float32 positions of all clusters of a scene."""
    rng = np.random.default_rng(scene.seed)
    specs = []
    for group in scene.clusters:
        for _ in range(group.n_clusters):
            d = {k: draw(v, rng) for k, v in group.dimensions.items()}
            n = points_for(group.type, d, draw(group.density_factor, rng), scene.min_pts)
            q = group.rotation if isinstance(group.rotation, tuple) else rng.normal(size=4) if group.rotation == "random" else (1, 0, 0, 0)
            specs.append((group.type, d, n, rotation_matrix(q)))
    middle = place_centres(len(specs), scene.cluster_distance, scene.eps, rng)
    parts = [moved(local_points(spark, kind, d, n, scene.eps, scene.seed + k), m, middle[k]).withColumn("cluster", F.lit(k + 1)) for k, (kind, d, n, m) in enumerate(specs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("cluster", *[F.col(c).cast("float").alias(c) for c in "xyz"])


def _candidates(spark: SparkSession, occupied: DataFrame, kind: str, distance, eps: float, n: int, seed: int) -> DataFrame:
    r = _Random(seed * 7919)
    if kind == "uniform":
        box = bounding_box(occupied, 5 * eps).first()
        df = spark.range(n).withColumns({c: r.uniform(box[f"min_{c}"], box[f"max_{c}"]) for c in "xyz"})
    else:
        low, high = distance if isinstance(distance, tuple) else (distance, 1.5 * distance)
        total = occupied.count()
        numbered = occupied.select(*[F.col(c).alias(f"o{c}") for c in "xyz"]).withColumn("_n", F.monotonically_increasing_id())
        share = min(1.0, 3 * n / max(1, total))
        seeds = numbered.where(F.rand(seed) < share)
        df = seeds.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(max(1, math.ceil(n / max(1.0, total * share))))))).withColumns({f"_{c}": r.normal() for c in "xyz"})
        df = df.withColumn("_r", r.uniform(low * eps, high * eps) / F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2))
        df = df.select(*[(F.col(f"o{c}") + F.col(f"_{c}") * F.col("_r")).alias(c) for c in "xyz"])
    return df.select(F.monotonically_increasing_id().alias("point_id"), *[F.col(c).cast("float").alias(c) for c in "xyz"])


def with_noise(spark: SparkSession, scene: Scene, points: DataFrame) -> DataFrame:
    """Adds noise (cluster 0): every kind keeps its distance from clusters and from the kinds before it.

    Candidates of one kind are not compared with each other.
    """
    points = cut(points, "scene")
    base = points.count()
    for k, group in enumerate(scene.noise):
        need, got = round(group.ratio * base), None
        keep = scene.eps if group.type == "uniform" else scene.eps / 2
        for attempt in range(6):
            found = cut(far_candidates(cut(_candidates(spark, points, group.type, group.distance, scene.eps, need * 2 << attempt, scene.seed + 31 * k + attempt), "candidates"), points, keep).limit(need), "noise")
            got = found
            if found.count() >= need:
                break
        else:
            warnings.warn(f"{group.type} noise: {found.count()} of {need} points found a place", stacklevel=2)
        points = cut(points.unionByName(got.select(F.lit(0).alias("cluster"), "x", "y", "z")), "scene")
    return points


def generate(spark: SparkSession, scene: Scene) -> DataFrame:
    """``point_id, cluster, x, y, z`` of a scene; cluster 0 is noise as generated."""
    whole = with_noise(spark, scene, clusters(spark, scene))
    return cut(whole.withColumn("point_id", F.monotonically_increasing_id()), "scene").select("point_id", "cluster", "x", "y", "z")
