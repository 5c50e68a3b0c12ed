"""Writers of labelled clouds: coloured XYZ, coloured PLY, one file for each cluster, and labelled scenes.

Lines are formatted and sorted by Spark; a single named file is then put together from the ordered part files through
Hadoop's file systems, so a target may lie on any store that Spark writes to.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.exprs import is_finite, label_color, morton_code, voxel_coordinate
from pointweave.sources.clouds import extension


def is_single_file(path: str) -> bool:
    """``.xyz`` and ``.ply`` name a file; anything else, ``.bin`` too, a folder."""
    return extension(path) in (".xyz", ".ply")


def _lines(labelled: DataFrame, eps: float, colored: bool) -> DataFrame:
    xyz = [F.col(c).cast("double") for c in "xyz"]
    cells = {f"v{c}": F.when(is_finite(c), voxel_coordinate(c, eps)).otherwise(F.lit(0)) for c in "xyz"}  # no cell: any place will do
    ordered = labelled.withColumns(cells).withColumn("_order", morton_code())
    if colored:
        ordered = ordered.withColumn("_c", label_color())
        line = F.format_string("%.6f %.6f %.6f %d %d %d", *xyz, *[F.col(f"_c.{n}").cast("int") for n in "rgb"])
    else:
        line = F.format_string("%.6f %.6f %.6f", *xyz)
    return ordered.select("label", "_order", "point_id", line.alias("line"))


class _Store:
    """The file system that Spark uses for a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.at(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)

    def at(self, path: str, *below: str):
        found = self.jvm.org.apache.hadoop.fs.Path(path)
        for name in below:
            found = self.jvm.org.apache.hadoop.fs.Path(found, name)
        return found

    def names(self, folder, prefix: str) -> list[str]:
        found = (f.getPath().getName() for f in self.fs.listStatus(folder))
        return sorted(n for n in found if n.startswith(prefix))

    def join(self, folder, target, header: bytes = b"") -> None:
        """Writes a header and the part files of a folder, in order, as one file; a part at a time passes the driver."""
        out = self.fs.create(target, True)
        try:
            out.write(bytearray(header))
            for name in self.names(folder, "part-"):
                part = self.fs.open(self.at(folder.toString(), name))
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
        finally:
            out.close()


def write_single(labelled: DataFrame, path: str, eps: float) -> None:
    """One coloured file in Morton order, noise included."""
    if not is_single_file(path):
        raise ValueError(f"unsupported output format: {path}")
    store = _Store(labelled.sparkSession, path)
    folder = store.root.getParent()
    if folder is not None and not (store.fs.exists(folder) and store.fs.getFileStatus(folder).isDirectory()):
        raise OSError(f"cannot open output file: {path}")
    lines = _lines(labelled, eps, True).orderBy("_order", "point_id").select("line")
    header = b""
    if extension(path) == ".ply":
        names = [f"property float {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
        header = ("\n".join(["ply", "format ascii 1.0", f"element vertex {labelled.count()}", *names, "end_header"]) + "\n").encode()
    parts = f"{path}.parts"
    lines.write.mode("overwrite").text(parts)
    try:
        store.join(store.at(parts), store.root, header)
    finally:
        store.fs.delete(store.at(parts), True)


def write_split(labelled: DataFrame, folder: str, eps: float) -> None:
    """``noise.xyz`` (also if empty) and ``cluster_<k>.xyz``; other files in the folder stay."""
    store = _Store(labelled.sparkSession, folder)
    store.fs.mkdirs(store.root)
    parts = store.at(folder, ".parts")
    lines = _lines(labelled, eps, False).repartition("label").sortWithinPartitions("label", "_order", "point_id")
    lines.select("label", "line").write.mode("overwrite").partitionBy("label").text(parts.toString())
    try:
        store.fs.create(store.at(folder, "noise.xyz"), True).close()
        for name in store.names(parts, "label="):
            label = int(name.partition("=")[2])
            store.join(store.at(parts.toString(), name), store.at(folder, "noise.xyz" if label == 0 else f"cluster_{label}.xyz"))
    finally:
        store.fs.delete(parts, True)


def write(labelled: DataFrame, path: str, eps: float) -> None:
    (write_single if is_single_file(path) else write_split)(labelled, path, eps)


def scene_comment(eps: float, min_pts: int, sizes: list[int], noise: int, tag: str = "scene") -> str:
    """The metadata comment of a scene; readers that expect another first word can be given it as ``tag``."""
    return f"{tag} eps={eps} min_pts={min_pts} n_clusters={len(sizes)} n_noise={noise} sizes={','.join(map(str, sorted(sizes)))}"


def write_scene(path: str, points: np.ndarray, labels: np.ndarray, colors: np.ndarray, comment: str) -> None:
    """A labelled scene as binary PLY: x, y, z float, label int (-1: noise), red, green, blue uchar."""
    if not (points.shape == (len(labels), 3) and colors.shape == (len(labels), 3)):
        raise ValueError("points, labels and colours must have as many rows")
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("label", "<i4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
    table = np.zeros(len(labels), kind)
    for k, c in enumerate("xyz"):
        table[c] = points[:, k]
    table["label"] = labels
    for k, c in enumerate(("red", "green", "blue")):
        table[c] = colors[:, k]
    names = {"f": "float", "i": "int", "u": "uchar"}
    head = ["ply", "format binary_little_endian 1.0", f"comment {comment}", f"element vertex {len(labels)}", *[f"property {names[kind[n].kind]} {n}" for n in kind.names], "end_header"]
    Path(path).write_bytes(("\n".join(head) + "\n").encode() + table.tobytes())
