"""Scene descriptions and their JSON form.  All lengths are in units of epsilon; a pair of numbers is a range to draw from."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

Number = float | tuple[float, float]

#: Dimensions of each cluster type.
DIMENSIONS = {
    "gaussian": ("std",),
    "crescent": ("radius", "thickness", "arc_fraction"),
    "torus": ("major_radius", "aspect_ratio"),
    "tube": ("length", "radius"),
    "cylinder": ("radius", "height"),
    "ball": ("radius",),
    "box": ("width", "height", "depth"),
}
#: Dimensions that are not lengths.
RATIOS = ("arc_fraction", "aspect_ratio")


@dataclass(frozen=True)
class ClusterGroup:
    type: str
    n_clusters: int
    density_factor: Number
    dimensions: dict[str, Number]
    rotation: str | tuple[float, float, float, float] = "random"


@dataclass(frozen=True)
class NoiseGroup:
    type: str
    ratio: float
    distance: Number = (1.0, 1.5)


@dataclass(frozen=True)
class Scene:
    id: str
    seed: int
    eps: float
    min_pts: int
    cluster_distance: Number
    clusters: tuple[ClusterGroup, ...]
    noise: tuple[NoiseGroup, ...] = field(default=())


def _number(value) -> Number:
    if isinstance(value, dict):
        value = (value["min"], value["max"])
    if isinstance(value, (list, tuple)):
        low, high = map(float, value)
        if low > high:
            raise ValueError(f"the range {value} is empty")
        return low, high
    return float(value)


def parse_scene(data: dict) -> Scene:
    """A scene from JSON data; unknown types and missing dimensions are errors."""
    if not data.get("clusters"):
        raise ValueError("a scene needs clusters")
    clusters, noise = [], []
    for c in data["clusters"]:
        if c.get("type") not in DIMENSIONS:
            raise ValueError(f"unknown cluster type {c.get('type')!r}")
        if missing := [d for d in ("n_clusters", *DIMENSIONS[c["type"]]) if d not in c]:
            raise ValueError(f"{c['type']} needs {', '.join(missing)}")
        rotation = c.get("rotation", "random")
        if isinstance(rotation, (list, tuple)):
            rotation = tuple(map(float, rotation))
            if len(rotation) != 4:
                raise ValueError("a quaternion has four numbers: w, x, y, z")
        elif rotation not in ("none", "random"):
            raise ValueError(f"unknown rotation {rotation!r}")
        clusters.append(ClusterGroup(c["type"], int(c["n_clusters"]), _number(c.get("density_factor", 2.0)), {d: _number(c[d]) for d in DIMENSIONS[c["type"]]}, rotation))
    for n in data.get("noise", ()):
        if n.get("type") not in ("uniform", "boundary"):
            raise ValueError(f"unknown noise type {n.get('type')!r}")
        if missing := [k for k in ("ratio", "distance_from_cluster")[: 1 + (n["type"] == "boundary")] if k not in n]:
            raise ValueError(f"{n['type']} noise needs {', '.join(missing)}")
        noise.append(NoiseGroup(n["type"], float(n["ratio"]), _number(n["distance_from_cluster"]) if n["type"] == "boundary" else (1.0, 1.5)))
    eps, min_pts = float(data["dbscan"]["eps"]), int(data["dbscan"]["min_pts"])
    if not eps > 0 or min_pts < 1:
        raise ValueError("eps must be over 0 and min_pts at least 1")
    return Scene(str(data["id"]), int(data["seed"]), eps, min_pts, _number(data["cluster_distance"]), tuple(clusters), tuple(noise))


def load_scene(path: str) -> Scene:
    return parse_scene(json.loads(Path(path).read_text()))


def draw(value: Number, rng: np.random.Generator) -> float:
    return float(rng.uniform(*value)) if isinstance(value, tuple) else float(value)


def volume(kind: str, d: dict[str, float]) -> float:
    """In cubic epsilon."""
    pi = np.pi
    if kind == "gaussian":
        return (2 * pi) ** 1.5 * d["std"] ** 3
    if kind == "crescent":
        return d["arc_fraction"] * pi**2 * d["radius"] * d["thickness"] ** 2 / 2
    if kind == "torus":
        return 2 * pi**2 * d["major_radius"] * (d["major_radius"] / d["aspect_ratio"]) ** 2
    if kind in ("tube", "cylinder"):
        return pi * d["radius"] ** 2 * d["length" if kind == "tube" else "height"]
    if kind == "ball":
        return 4 / 3 * pi * d["radius"] ** 3
    return d["width"] * d["height"] * d["depth"]


def points_for(kind: str, d: dict[str, float], density: float, min_pts: int) -> int:
    """Enough points that a sphere of radius epsilon holds ``density * min_pts`` on average; thin shapes are warned about."""
    for name, v in d.items():
        if name not in RATIOS and v < 2 and kind != "gaussian":
            warnings.warn(f"{kind}: {name} is under two epsilon", stacklevel=2)
    ball = 4 / 3 * np.pi
    return max(1, round(max(volume(kind, d), ball) * density * min_pts / ball))


def rotation_matrix(q) -> np.ndarray:
    """Of a quaternion (w, x, y, z) of any length but 0."""
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def place_centres(n: int, distance: Number, eps: float, rng: np.random.Generator, tries: int = 500) -> np.ndarray:
    """Centres that keep a distance from each other, each within reach of an earlier one; the middle is at the origin."""
    low, high = distance if isinstance(distance, tuple) else (distance, 2.5 * distance)
    low, high = low * eps, high * eps
    centres = [np.zeros(3)]
    while len(centres) < n:
        placed, reach = None, high
        for attempt in range(tries):
            direction = rng.normal(size=3)
            direction /= np.linalg.norm(direction)
            candidate = centres[rng.integers(len(centres))] + direction * rng.uniform(low, reach)
            if min(np.linalg.norm(candidate - c) for c in centres) >= low:
                placed = candidate
                break
            if attempt % 50 == 49:
                reach *= 1.2
        if placed is None:
            warnings.warn("no free place for a cluster; it is put outside the others", stacklevel=2)
            placed = direction * (max(np.linalg.norm(c) for c in centres) + low)  # at least ``low`` from each of them
        centres.append(placed)
    out = np.array(centres)
    return out - out.mean(0)
