"""Clustering against hand-made cases and a brute-force version."""

import math

import numpy as np
import pytest

from pointweave.operators import dbscan as D
from pointweave.operators import kernel
from pointweave.operators.dbscan import dbscan
from pointweave.operators.noise import far_candidates
from pointweave.operators.summary import cluster_summary, compare_sizes, label_map_differences

SCHEMA = "point_id long, x double, y double, z double"


def run(spark, points, eps, min_pts, **kw):
    rows = [(k, *map(float, p)) for k, p in enumerate(points)]
    got = dbscan(spark.createDataFrame(rows, SCHEMA), eps, min_pts, **kw).select("point_id", "label").collect()
    labels = dict(map(tuple, got))
    assert len(got) == len(points)
    return [labels[k] for k in range(len(points))]


def line(*xs):
    return [(x, 0, 0) for x in xs]


def cluster_count(labels):
    return len({v for v in labels if v})


PLUS = [(0, 0, 0), (0, 0, 0.5), (0, 0.5, 0), (0, 0, -0.5), (0, -0.5, 0)]
CASES = {
    "empty": ([], 1.0, 2, 0, 0),
    "one point, min 1": (line(0), 1.0, 1, 1, 0),
    "one point, min 2": (line(0), 1.0, 2, 0, 1),
    "two near": (line(0, 0.5), 1.0, 2, 1, 0),
    "two of three": (line(0, 0.5), 1.0, 3, 0, 2),
    "at eps": (line(0, 1), 1.0, 2, 1, 0),
    "just over eps": (line(0, float(np.nextafter(np.float32(1), np.float32(2)))), 1.0, 2, 0, 2),
    "border": ([(0, 0, 0), (0.2, 0, 0), (0, 0.2, 0), (0.2, 0.2, 0), (0.1, 0.1, 0), (0.7, 0, 0), (1.3, 0, 0)], 0.6, 5, 1, 1),
    "two groups": (line(0, 0.1, 0.2, 10, 10.1, 10.2), 0.5, 2, 2, 0),
    "bridge": ([*PLUS, *[(x + 5, y, z) for x, y, z in PLUS], (2.5, 0, 0)], 2.5, 5, 2, 0),
    "duplicates reach": (line(0, 0, 0, 0, 0), 0.1, 5, 1, 0),
    "duplicates fall short": (line(0, 0, 0), 0.1, 5, 0, 3),
    "chain min 2": (line(0, 1, 2, 3), 1.0, 2, 1, 0),
    "chain min 3": (line(0, 1, 2, 3), 1.0, 3, 1, 0),
    "far out": (line(0, 0.3, 1e30), 0.5, 2, 1, 1),
    "both far out": (line(1e30, 1e30, 0), 0.5, 2, 1, 1),
    "signed zeros": ([(0.0, 0, 0), (-0.0, 0, 0)], 0.1, 2, 1, 0),
    "not finite": (line(0, 0.1, math.nan, math.inf, -math.inf), 0.5, 2, 1, 3),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    points, eps, min_pts, clusters, noise = CASES[name]
    labels = run(spark, points, eps, min_pts)
    assert (cluster_count(labels), labels.count(0)) == (clusters, noise)
    assert run(spark, points, eps, min_pts, task_points=0) == labels  # the distributed plan


def test_insertion_order_does_not_change_labels(spark):
    points = line(0, 0.1, 0.2, 10, 10.1, 10.2)
    assert run(spark, points, 0.5, 2) == run(spark, points[::-1], 0.5, 2)[::-1]


def test_shared_border_takes_the_lower_label(spark):
    left, right = [(x / 10, 0, 0) for x in range(5)], [(2 + x / 10, 0, 0) for x in range(5)]
    labels = run(spark, [*left, *right, (1.2, 0, 0)], 0.85, 5)
    assert labels == [1] * 5 + [2] * 5 + [1]


def brute_force(points, eps, min_pts):
    """Breadth-first over a distance matrix in float32."""
    p = np.asarray(points, np.float32).reshape(-1, 3)
    d = p[:, None, :] - p[None, :, :]
    near = (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= np.float32(eps) * np.float32(eps)
    core = near.sum(1) >= min_pts
    inv = np.nextafter(np.float32(1) / np.float32(eps), np.float32(0))
    v = np.floor(np.clip(p * inv, -(1 << 20), (1 << 20) - 1)).astype(int) + (1 << 20)
    code = [sum(((int(c) >> i) & 1) << (3 * i + k) for k, c in enumerate(row) for i in range(21)) for row in v]
    labels, last = [0] * len(p), 0
    for k in sorted(range(len(p)), key=lambda k: (code[k], k)):
        if core[k] and not labels[k]:
            last += 1
            labels[k], queue = last, [k]
            while queue:
                for m in np.flatnonzero(near[queue.pop()]):
                    if not labels[m]:
                        labels[m] = last
                        if core[m]:
                            queue.append(m)
    return labels


@pytest.mark.parametrize(("seed", "eps", "min_pts", "scale"), [(1, 0.5, 4, 3), (2, 0.35, 3, 2), (3, 1.0, 8, 4), (4, 0.5, 2, 1000)])
def test_random_clouds(spark, seed, eps, min_pts, scale):
    rng = np.random.default_rng(seed)
    points = rng.normal(0, scale, (250, 3)) if seed != 2 else rng.integers(-4, 5, (250, 3)) * eps
    points = np.float32(points)
    expected = brute_force(points, eps, min_pts)
    assert run(spark, points, eps, min_pts) == expected
    assert run(spark, points, eps, min_pts, task_points=0) == expected
    assert run(spark, points, eps, min_pts, task_points=0, driver_edges=0) == expected  # components found in Spark


@pytest.mark.parametrize("limits", [{}, {"CANDIDATES": 50}, {"CANDIDATES": 50, "LINKS": 10}])
def test_kernel_on_random_clouds(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(kernel, name, value)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        eps = [0.5, 0.35, 1.0][seed % 3]
        points = np.float32(rng.normal(0, [1, 3, 300][seed % 3], (120, 3)) if seed % 2 else rng.integers(-3, 4, (120, 3)) * eps)
        points = np.concatenate([points, points[:9], np.float32([[3e7, 0, 0], [3e7, 0, 0], [-3e7, 1, 1], [np.nan, 0, 0], [np.inf, 0, 0]])])
        is_core, label = kernel.cluster(points, np.arange(len(points)), eps, 2 + seed % 5)
        fine = np.isfinite(points).all(1)
        assert label[fine].tolist() == brute_force(points[fine], eps, 2 + seed % 5)
        assert not label[~fine].any() and not is_core[~fine].any()


@pytest.mark.parametrize("task_points", [0, 5, 250_000])
def test_ids_may_repeat_from_key_to_key(spark, task_points):
    rng = np.random.default_rng(6)
    clouds = {k: np.float32(rng.normal(0, 1.5, (n, 3))) for k, n in (("a", 60), ("b", 4), (None, 50), ("c", 90))}
    rows = [(key, i, *map(float, p)) for key, cloud in clouds.items() for i, p in enumerate(cloud)]
    got = dbscan(spark.createDataFrame(rows, f"scan string, {SCHEMA}"), 0.6, 3, "scan", task_points=task_points).collect()
    assert len(got) == len(rows)
    for key, cloud in clouds.items():
        labels = {r["point_id"]: r["label"] for r in got if r["scan"] == key}
        assert [labels[i] for i in range(len(cloud))] == brute_force(cloud, 0.6, 3)


@pytest.mark.parametrize(("eps", "min_pts"), [(0, 1), (-1, 1), (math.nan, 1), (math.inf, 1), (1, 0)])
def test_parameters(spark, eps, min_pts):
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame([], SCHEMA), eps, min_pts)


def test_groups_are_apart(spark):
    rows = [(k, "a" if k < 4 else "b", float(k % 4) / 10, 0.0, 0.0) for k in range(8)]
    got = dbscan(spark.createDataFrame(rows, "point_id long, scan string, x double, y double, z double"), 0.5, 3, "scan").collect()
    assert {(r["scan"], r["label"]) for r in got} == {("a", 1), ("b", 1)}


def test_summaries(spark):
    df = spark.createDataFrame([(k, 0.0, 0.0, 0.0, lab) for k, lab in enumerate([0, 1, 1, 2, 2, 2])], "point_id long, x double, y double, z double, label long")
    assert tuple(cluster_summary(df).first()) == (6, 2, 2, 1)
    sizes = df.where("label > 0").groupBy("label").count().selectExpr("count AS size")
    assert all(compare_sizes(sizes, sizes, 1, 4).values())
    assert label_map_differences(df, df).count() == 0


def test_plan_broadcasts_no_points(spark, monkeypatch):
    """Small as these tables are, no join of points, pairs or labels may be planned as a broadcast."""
    plans = {}
    real = D.cut

    def seen(df, name="cut"):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return real(df, name)

    monkeypatch.setattr(D, "cut", seen)
    rows = [(k, float(p % 10), float(p // 10), 0.0) for k, p in enumerate([*range(100), *range(50)])]
    labelled = dbscan(spark.createDataFrame(rows, SCHEMA), 1.0, 4, task_points=0)
    plans["labels"] = labelled._jdf.queryExecution().sparkPlan().toString()
    joins = [(name, line) for name, plan in plans.items() for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert {"pairs", "core", "links", "core-labels", "site-labels"} < set(plans)
    assert [j for j in joins if "_part" not in j[1]] == []  # offsets of partitions, a row for each
    assert {r["label"] for r in labelled.collect()} == {1}


def test_far_candidates_broadcast_no_points(spark):
    at = lambda *xs: D.cut(spark.createDataFrame([(k, x, 0.0, 0.0) for k, x in enumerate(xs)], SCHEMA))
    far = far_candidates(at(0.0, 0.5, 1.0, 3.0), at(0.0, 0.0, 4.0), 1.0)
    assert "Broadcast" not in far._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r["point_id"] for r in far.collect()) == [2, 3]


def test_components_stay_off_the_driver(spark, monkeypatch):
    """Neither links nor their ends are collected or sent from the driver, and the small way agrees with the one by joins."""
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2000, 2)) if a != b]
    edges = D.cut(spark.createDataFrame(pairs, "a long, b long"))
    empty = D.cut(spark.createDataFrame([], "a long, b long"))

    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas", "collect", "toLocalIterator"):
            m.setattr(type(edges), name, refuse)
        m.setattr(type(spark), "createDataFrame", refuse)
        few, none = D.components(edges), D.components(empty)
    assert "LocalTableScan" not in few._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, D.components(edges, 0).collect()))
    assert none.collect() == []


@pytest.mark.parametrize(("bits", "most"), [((3,), 250_000), ((6, 3), 100), ((3,), 0)])
@pytest.mark.parametrize(("seed", "eps", "min_pts", "scale"), [(1, 0.5, 4, 3), (2, 0.35, 3, 2), (7, 0.3, 5, 1.5), (4, 0.5, 2, 1000)])
def test_tiles_on_random_clouds(spark, monkeypatch, bits, most, seed, eps, min_pts, scale):
    """Small tiles, tiles that are made smaller, and none at all give the labels of brute force."""
    monkeypatch.setattr(D, "TILE_BITS", bits)
    monkeypatch.setattr(D, "TILE_SITES", most)
    rng = np.random.default_rng(seed)
    points = np.float32(rng.normal(0, scale, (400, 3)) if seed != 2 else rng.integers(-9, 10, (400, 3)) * eps)
    points = np.concatenate([points, points[:20]])
    assert run(spark, points, eps, min_pts, task_points=0) == brute_force(points, eps, min_pts)


def test_tiles_of_keys(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE_BITS", (3,))
    rng = np.random.default_rng(8)
    clouds = {k: np.float32(rng.normal(0, 3, (n, 3))) for k, n in (("a", 200), ("b", 4), (None, 250))}
    rows = [(key, i, *map(float, p)) for key, cloud in clouds.items() for i, p in enumerate(cloud)]
    got = dbscan(spark.createDataFrame(rows, f"scan string, {SCHEMA}"), 0.6, 3, "scan", task_points=0).collect()
    assert len(got) == len(rows)
    for key, cloud in clouds.items():
        labels = {r["point_id"]: r["label"] for r in got if r["scan"] == key}
        assert [labels[i] for i in range(len(cloud))] == brute_force(cloud, 0.6, 3)


def test_only_sides_of_tiles_leave_them(spark, monkeypatch):
    """A chain through several tiles: components get the sites along their sides, not every link, and so need few jobs."""
    given = []
    real = D.components
    monkeypatch.setattr(D, "components", lambda edges, most: given.append(edges.count()) or real(edges, most))
    assert run(spark, line(*[k / 2 for k in range(-400, 400)]), 1.0, 3, task_points=0) == [1] * 800
    assert given and given[0] < 100
