"""Readers, writers, the programs, scenes and the stream."""

import json
import struct

import numpy as np
import pytest

from pointweave import cli
from pointweave.sources import clouds, sinks
from pointweave.synth import scene as sc
from pointweave.synth import shapes

ASCII = b"ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty uchar red\nproperty float z\nproperty double x\nproperty float y\nelement face 0\nproperty list uchar int v\nend_header\n1 3 1 2\n2 6 4 5\n"


def test_xyz():
    assert clouds.parse_xyz(b"1 2 3 9\n\n4 5 6\n").tolist() == [[1, 2, 3], [4, 5, 6]]
    for bad in (b"1_0 2 3\n", b"# x\n", b"1 2\n", b"nan 0 0\n", b"a b c\n"):
        with pytest.raises(ValueError, match=r"invalid \.xyz row"):
            clouds.parse_xyz(bad)


def test_scan_ignores_an_incomplete_record():
    assert clouds.parse_scan(struct.pack("<8f", *range(8)) + b"123").tolist() == [[0, 1, 2], [4, 5, 6]]
    assert clouds.parse_scan(b"").shape == (0, 3)


def test_ply():
    assert clouds.parse_ply(ASCII).tolist() == [[1, 2, 3], [4, 5, 6]]
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty double y\nproperty short z\nend_header\n"
    assert clouds.parse_ply(head + struct.pack("<fdh", 1, 2, 3)).tolist() == [[1, 2, 3]]
    cases = [
        ASCII.replace(b"ply\n", b"plx\n", 1), ASCII.replace(b"ascii", b"binary_big_endian"), ASCII.replace(b"vertex 2", b"vertex 0"), ASCII.replace(b"vertex 2", b"vertex 3"), ASCII.replace(b"float y", b"float w"),
        ASCII.replace(b"uchar red", b"list uchar int red"), ASCII.replace(b"element vertex 2", b"element camera 1\nelement vertex 2"), head + b"12", head.replace(b"short", b"half") + b"0" * 20, head[:-11],
    ]
    for bad in cases:
        with pytest.raises(ValueError):
            clouds.parse_ply(bad)


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="unsupported input format"):
        clouds.read_point_cloud(spark, "a.las")


def test_columns_and_append(spark):
    with pytest.raises(ValueError):
        clouds.from_columns(spark, [1], [1, 2], [1])
    cloud = clouds.from_columns(spark, [1, 2], [0, 0], [0, 0])
    more = clouds.append(cloud, clouds.from_columns(spark, [3], [0], [0]))
    assert sorted(map(tuple, more.collect())) == [(0, 1, 0, 0), (1, 2, 0, 0), (2, 3, 0, 0)]


def test_many_scans(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.bin").write_bytes(struct.pack("<4f", k, 0, 0, 0) * 2)
    got = clouds.read_scans(spark, str(tmp_path), stride=2, most=2)
    assert sorted(r["x"] for r in got.collect()) == [0, 0, 2, 2]
    with pytest.raises(FileNotFoundError):
        clouds.read_scans(spark, str(tmp_path), "*.pcd")


def test_program(spark, tmp_path, capsys):
    source = tmp_path / "in.XYZ"
    source.write_text("".join(f"{x} 0 0\n" for x in (0, 0.1, 0.2, 9)))
    for out in ("out.xyz", "out.ply", "parts"):
        assert cli.main(["-i", str(source), "-o", str(tmp_path / out), "-e", "0.5", "--min-points", "2"]) == 0
        assert f"points=4 clusters=1 output={tmp_path / out}" in capsys.readouterr().out
    lines = (tmp_path / "out.xyz").read_text().splitlines()
    assert len(lines) == 4 and lines[-1] == "9.000000 0.000000 0.000000 96 96 96"
    assert clouds.parse_ply((tmp_path / "out.ply").read_bytes()).shape == (4, 3)
    assert (tmp_path / "parts/noise.xyz").read_text() == "9.000000 0.000000 0.000000\n"
    assert len((tmp_path / "parts/cluster_1.xyz").read_text().splitlines()) == 3
    assert cli.main(["-i", str(source), "-o", str(tmp_path / "x.xyz"), "-e", "0", "-m", "2"]) == 1
    assert cli.main(["-i", str(source), "-o", str(tmp_path / "none/x.xyz"), "-e", "1", "-m", "2"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["-i", "no such file", "-o", "x", "-e", "1", "-m", "2"])


def test_split_writes_empty_noise(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1)], "point_id long, x float, y float, z float, label long")
    sinks.write(df, str(tmp_path / "o.bin"), 1.0)
    assert (tmp_path / "o.bin/noise.xyz").read_bytes() == b""


SCENE = {"id": "s", "seed": 5, "dbscan": {"eps": 0.5, "min_pts": 5}, "cluster_distance": [14, 20], "clusters": [{"type": "ball", "n_clusters": 2, "radius": [2.0, 2.5], "density_factor": 3.0}, {"type": "torus", "n_clusters": 1, "major_radius": 4, "aspect_ratio": 2, "rotation": "random", "density_factor": 3.0}], "noise": [{"type": "uniform", "ratio": 0.05}]}


def test_scene_round_trip(spark, tmp_path):
    from pointweave.synth.cli import main

    (tmp_path / "s.json").write_text(json.dumps(SCENE))
    assert main([str(tmp_path / "s.json"), str(tmp_path / "s.ply")]) == 0
    meta, columns = clouds.read_labelled_ply((tmp_path / "s.ply").read_bytes())
    assert meta["eps"] == "0.5" and int(meta["n_clusters"]) >= 3
    assert sum(meta["sizes"]) + int(meta["n_noise"]) == len(columns["x"]) and (columns["label"] == -1).sum() == int(meta["n_noise"])


@pytest.mark.parametrize("kind", list(sc.DIMENSIONS))
def test_shapes_stay_in_bounds(spark, kind):
    d = dict.fromkeys(sc.DIMENSIONS[kind], 3.0) | ({"arc_fraction": 0.5} if kind == "crescent" else {})
    p = shapes.local_points(spark, kind, d, 500, 1.0, 1).toPandas().to_numpy()
    assert p.shape == (500, 3) and np.isfinite(p).all()
    assert np.abs(p).max() < (20 if kind == "gaussian" else 5)


def test_shapes_are_uniform_in_their_volume(spark):
    p = {kind: shapes.local_points(spark, kind, d, 4000, 1.0, 3).toPandas().to_numpy() for kind, d in {"ball": {"radius": 2.0}, "torus": {"major_radius": 4.0, "aspect_ratio": 2.0}, "cylinder": {"radius": 2.0, "height": 5.0}, "tube": {"radius": 0.5, "length": 5.0}, "box": {"width": 1.0, "height": 2.0, "depth": 4.0}, "gaussian": {"std": 1.5}, "crescent": {"radius": 4.0, "thickness": 1.0, "arc_fraction": 0.25}}.items()}
    assert np.linalg.norm(p["ball"], axis=1).mean() == pytest.approx(1.5, abs=0.03)  # three quarters of the radius
    flat = np.hypot(p["torus"][:, 0], p["torus"][:, 1])
    assert (np.hypot(flat - 4, p["torus"][:, 2]) <= 2 + 1e-9).all() and flat.mean() == pytest.approx(4 + 4 / 16, abs=0.06)
    for kind, radius in (("cylinder", 2.0), ("tube", 0.5)):
        assert np.hypot(p[kind][:, 0], p[kind][:, 1]).mean() == pytest.approx(radius * 2 / 3, rel=0.02) and np.abs(p[kind][:, 2]).max() <= 2.5
    assert np.abs(p["box"]).max(0) == pytest.approx([0.5, 1.0, 2.0], rel=0.02) and p["box"].std(0) == pytest.approx(np.array([1, 2, 4]) / 12**0.5, rel=0.05)
    assert p["gaussian"].std(0) == pytest.approx([1.5] * 3, rel=0.05)
    turn = np.arctan2(p["crescent"][:, 1], p["crescent"][:, 0])
    assert turn.min() >= 0 and turn.max() <= np.pi / 2 and (np.hypot(np.hypot(p["crescent"][:, 0], p["crescent"][:, 1]) - 4, p["crescent"][:, 2]) <= 0.5 + 1e-9).all()


def test_defaults_of_a_scene():
    scene = sc.parse_scene({k: v for k, v in SCENE.items() if k != "noise"} | {"clusters": [{"type": "ball", "n_clusters": 1, "radius": 2}], "noise": [{"type": "boundary", "ratio": 0.1, "distance_from_cluster": [1.0, 2.0]}]})
    assert scene.clusters[0].rotation == "random" and scene.clusters[0].density_factor == 2.0
    assert scene.noise[0].distance == (1.0, 2.0)
    for bad in ({"noise": [{"type": "boundary", "ratio": 0.1}]}, {"clusters": [{"type": "ball", "radius": 2}]}):
        with pytest.raises(ValueError):
            sc.parse_scene(SCENE | bad)


def test_forced_places_keep_the_distance():
    with pytest.warns(UserWarning, match="no free place"):
        c = sc.place_centres(60, (5.0, 5.1), 1.0, np.random.default_rng(0), tries=1)
    d = np.linalg.norm(c[:, None] - c[None], axis=2)
    assert d[~np.eye(60, dtype=bool)].min() >= 5.0 - 1e-6 and np.allclose(c.mean(0), 0)


SCENES = {
    "balls and cylinders": {"eps": 0.5, "min_pts": 5, "clusters": [("ball", {"radius": [2.0, 3.0]}), ("cylinder", {"radius": 2.0, "height": 4.0})], "noise": [("uniform", 0.06)]},
    "all shapes": {"eps": 0.35, "min_pts": 8, "clusters": [("gaussian", {"std": [0.8, 1.0]}), ("crescent", {"radius": 4.0, "thickness": 2.0, "arc_fraction": 0.6}), ("torus", {"major_radius": 4.0, "aspect_ratio": 2.0}), ("tube", {"length": 6.0, "radius": 1.0}), ("box", {"width": 3.0, "height": 3.0, "depth": 2.0})], "noise": [("uniform", 0.08), ("boundary", 0.05)]},
}


@pytest.mark.parametrize("name", SCENES)
def test_scenes_by_tolerance(spark, tmp_path, name):
    """A generated file, read again and clustered by the distributed plan, agrees with the labels written into it."""
    from pointweave.operators.dbscan import dbscan
    from pointweave.operators.summary import cluster_sizes, compare_sizes
    from pointweave.synth.cli import main

    want = SCENES[name]
    clusters = [{"type": t, "n_clusters": 2, "density_factor": 3.0, **d} for t, d in want["clusters"]]
    noise = [{"type": t, "ratio": r, **({"distance_from_cluster": [1.5, 2.5]} if t == "boundary" else {})} for t, r in want["noise"]]
    scene = {"id": name, "seed": 11, "dbscan": {"eps": want["eps"], "min_pts": want["min_pts"]}, "cluster_distance": [16, 22], "clusters": clusters, "noise": noise}
    (tmp_path / "s.json").write_text(json.dumps(scene))
    assert main([str(tmp_path / "s.json"), str(tmp_path / "s.ply")]) == 0
    meta, columns = clouds.read_labelled_ply((tmp_path / "s.ply").read_bytes())
    assert int(meta["n_clusters"]) >= 2 * len(clusters)
    base = len(columns["x"]) / (1 + sum(r for _, r in want["noise"]))
    assert abs(len(columns["x"]) - base - sum(round(base * r) for _, r in want["noise"])) <= 2
    got = dbscan(clouds.read_point_cloud(spark, str(tmp_path / "s.ply")), want["eps"], want["min_pts"], task_points=0)
    sizes = spark.createDataFrame([(k,) for k in meta["sizes"]], "size long")
    assert all(compare_sizes(cluster_sizes(got), sizes, got.where("label = 0").count(), int(meta["n_noise"])).values())


def test_sizes_off_by_more_than_the_tolerance(spark):
    from pointweave.operators.summary import compare_sizes

    table = lambda *sizes: spark.createDataFrame([(k,) for k in sizes], "size long")
    assert all(compare_sizes(table(100, 55), table(60, 97), 105, 100).values())
    assert not compare_sizes(table(100, 54), table(60, 97), 100, 100)["sizes_match"]
    assert not compare_sizes(table(100), table(60, 97), 100, 100)["clusters_match"]
    assert not compare_sizes(table(100), table(100), 106, 100)["noise_match"]


def test_scans_are_clustered_apart(spark, tmp_path):
    """Ids begin anew in each file; each scan's labels are those of the scan alone."""
    from pointweave.operators.dbscan import dbscan

    rng = np.random.default_rng(8)
    for k in range(3):
        points = np.concatenate([rng.normal(0, 0.4 + 0.3 * k, (60 + 20 * k, 3)), np.zeros((60 + 20 * k, 1))], axis=1)
        (tmp_path / f"{k}.bin").write_bytes(points.astype("<f4").tobytes())
    for limit in (0, 250_000):
        got = dbscan(clouds.read_scans(spark, str(tmp_path)), 0.4, 4, "path", task_points=limit).collect()
        assert len(got) == 60 + 80 + 100
        for k in range(3):
            alone = dbscan(clouds.read_point_cloud(spark, str(tmp_path / f"{k}.bin")), 0.4, 4).collect()
            assert {(r["point_id"], r["label"]) for r in got if r["path"].endswith(f"{k}.bin")} == {(r["point_id"], r["label"]) for r in alone}


def test_first_position(spark):
    from pointweave.operators.index import sorted_positions
    from pointweave.operators.summary import first_position

    df = spark.createDataFrame([(k, x, 0.0, 0.0) for k, x in enumerate([3.0, 1.5, 9.0, 1.5])], "point_id long, x float, y float, z float")
    assert first_position(sorted_positions(df, 1.0), 3.0).first()[0] == 2
    assert first_position(sorted_positions(df, 1.0), 7.0).first()[0] is None


def test_bad_scenes():
    for change in ({"clusters": []}, {"clusters": [{"type": "cone"}]}, {"clusters": [{"type": "ball", "n_clusters": 1}]}, {"noise": [{"type": "pink", "ratio": 1}]}, {"dbscan": {"eps": 0, "min_pts": 1}}):
        with pytest.raises((ValueError, KeyError)):
            sc.parse_scene(SCENE | change)


def test_stream(spark, tmp_path):
    from pointweave.streaming.scans import cluster_scans

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.bin").write_bytes(b"".join(struct.pack("<4f", k * 50 + x / 10, 0, 0, 0) for x in range(4)))
    query = cluster_scans(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 0.5, 2)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and {r["label"] for r in got.collect()} == {1}
