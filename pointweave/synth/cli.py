"""``python -m pointweave.synth.cli SCENE.json OUT.ply``: generate a scene, label it by clustering, write binary PLY."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pointweave-scene")
    p.add_argument("scene")
    p.add_argument("output")
    p.add_argument("--tag", default="scene", help="first word of the metadata comment")
    args = p.parse_args(argv)
    import numpy as np
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pointweave.functions.exprs import scene_color
    from pointweave.operators.dbscan import dbscan
    from pointweave.sources.sinks import scene_comment, write_scene
    from pointweave.synth.scene import load_scene
    from pointweave.synth.shapes import generate

    spark = SparkSession.builder.appName("pointweave-scene").getOrCreate()
    scene = load_scene(args.scene)
    print(f"[1/4] {scene.id}: generating")
    points = generate(spark, scene)
    print("[2/4] clustering")
    labelled = dbscan(points, scene.eps, scene.min_pts).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("int"))
    rows = labelled.withColumn("c", scene_color()).select("point_id", "x", "y", "z", "label", "c.r", "c.g", "c.b").toPandas().sort_values("point_id")  # a scene is small
    sizes = rows.loc[rows.label > 0, "label"].value_counts().tolist()
    expected = sum(g.n_clusters for g in scene.clusters)
    print(f"[3/4] {len(rows)} points, {len(sizes)} clusters, {int((rows.label < 0).sum())} noise")
    if len(sizes) != expected:
        print(f"warning: {expected} clusters were asked for", file=sys.stderr)
    write_scene(args.output, rows[["x", "y", "z"]].to_numpy(np.float32), rows.label.to_numpy(), rows[["r", "g", "b"]].to_numpy(), scene_comment(scene.eps, scene.min_pts, sizes, int((rows.label < 0).sum()), args.tag))
    print(f"[4/4] {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
