"""``python -m pointweave.cli -i IN -o OUT -e EPS -m N``: read a cloud, cluster it, write it, print a summary."""

from __future__ import annotations

import argparse
import math
import sys
from pathlib import Path

import numpy as np


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointweave", description="Cluster a point cloud by density.")
    p.add_argument("-i", "--input", required=True, help=".xyz, .bin or .ply file")
    p.add_argument("-o", "--output", required=True, help=".xyz or .ply file, or a folder for one file per cluster")
    p.add_argument("-e", "--epsilon", required=True, type=float, help="radius, over 0")
    p.add_argument("-m", "--min-pts", "--min-points", dest="min_pts", required=True, type=int, help="1 to 65535 points, the point itself included")
    p.add_argument("--help-all", action="help", help="show this help")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not Path(args.input).exists():
        p.error(f"--input: no such file: {args.input}")
    if not 0 <= args.min_pts <= 65535:
        p.error("--min-pts: out of range")
    eps = float(np.float32(args.epsilon))
    try:
        if not math.isfinite(eps) or eps <= 0:
            raise ValueError("epsilon must be finite and greater than 0")
        if args.min_pts < 1:
            raise ValueError("min-pts must be greater than 0")
        from pyspark.sql import SparkSession

        from pointweave.operators.dbscan import dbscan
        from pointweave.operators.summary import cluster_summary
        from pointweave.plans.lineage import cut
        from pointweave.sources.clouds import read_point_cloud
        from pointweave.sources.sinks import write

        spark = SparkSession.builder.appName("pointweave").getOrCreate()
        labelled = cut(dbscan(read_point_cloud(spark, args.input), eps, args.min_pts), "labelled")
        write(labelled, args.output, eps)
        total = cluster_summary(labelled).first()
        print(f"points={total['points']} clusters={total['clusters']} output={args.output}")
    except Exception as e:  # noqa: BLE001  reported to the caller of the program
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
