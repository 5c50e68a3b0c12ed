"""Readers of point-cloud files: ASCII XYZ, packed float32 scans and PLY.

Bytes are read by Spark's ``binaryFile`` reader (so any store that Spark reads will do) and parsed by one Arrow task for
each file: a point's id is its place in its file, which a split text scan would not keep.
"""

from __future__ import annotations

from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.scans import every_nth

SCHEMA = "path string, point_id long, x float, y float, z float"
#: PLY scalar types and their little-endian numpy names.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def parse_xyz(data: bytes) -> np.ndarray:
    """Rows of ``x y z``; empty lines are skipped, further tokens ignored, anything else is an error."""
    out = []
    for number, line in enumerate(data.decode("utf-8", "replace").split("\n"), 1):
        if not line:
            continue
        try:
            fields = line.split()[:3]
            x, y, z = map(float, fields)
            if "_" in "".join(fields) or not np.isfinite([x, y, z]).all():  # float() takes 1_0 for 10
                raise ValueError
        except ValueError:
            raise ValueError(f"invalid .xyz row {number}") from None
        out.append((x, y, z))
    return np.array(out, np.float32).reshape(-1, 3)


def parse_scan(data: bytes) -> np.ndarray:
    """Packed records of four float32 values, the last of which is dropped; an incomplete last record is ignored."""
    whole = len(data) // 16 * 16
    return np.frombuffer(data[:whole], "<f4").reshape(-1, 4)[:, :3]


def parse_ply_header(data: bytes) -> dict:
    """``count, ascii, properties [(type, name)], comments, body`` (where the vertex data begins)."""
    lines, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the .ply header does not end")
        line, at = data[at:end].decode("ascii", "replace").rstrip("\r"), end + 1
        lines.append(line)
        if len(lines) == 1 and line != "ply":
            raise ValueError("not a .ply file")
        if line.strip() == "end_header":
            break
    found = {"count": 0, "ascii": False, "properties": [], "comments": [], "body": at}
    element, first = None, None
    for line in lines[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "comment":
            found["comments"].append(line[len("comment ") :])
        elif words[0] == "format":
            if words[1:2] not in (["ascii"], ["binary_little_endian"]):
                raise ValueError("unsupported .ply format")
            found["ascii"] = words[1] == "ascii"
        elif words[0] == "element":
            element = words[1]
            first = first or element
            if element == "vertex":
                found["count"] = int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            found["properties"].append((words[1], words[2]))
    if first != "vertex":
        raise ValueError("the first element of a .ply file must be vertex")
    if not found["count"]:
        raise ValueError(".ply file does not contain vertex data")
    names = [n for _, n in found["properties"]]
    if missing := [c for c in "xyz" if c not in names]:
        raise ValueError(f".ply vertices have no {', '.join(missing)}")
    return found


def ply_vertices(data: bytes) -> dict[str, np.ndarray]:
    """All vertex properties as columns."""
    head = parse_ply_header(data)
    names = [n for _, n in head["properties"]]
    if unknown := [t for t, _ in head["properties"] if t not in PLY_TYPES]:
        raise ValueError(f"unknown .ply type {unknown[0]}")
    if head["ascii"]:
        lines = data[head["body"] :].decode("ascii", "replace").split("\n")
        rows = [x.split() for x in lines if x.strip()][: head["count"]]
        if len(rows) < head["count"] or any(len(r) < len(names) for r in rows):
            raise ValueError("the .ply body is incomplete")
        read = {n: (float if t in ("float", "float32", "double", "float64") else int) for t, n in head["properties"]}
        return {n: np.array([read[n](r[k]) for r in rows]) for k, n in enumerate(names)}
    kind = np.dtype([(n, PLY_TYPES[t]) for t, n in head["properties"]])
    if len(data) - head["body"] < kind.itemsize * head["count"]:
        raise ValueError("the .ply body is incomplete")
    table = np.frombuffer(data, kind, head["count"], head["body"])
    return {n: table[n] for n in names}


def parse_ply(data: bytes) -> np.ndarray:
    columns = ply_vertices(data)
    return np.stack([np.asarray(columns[c], np.float64).astype(np.float32) for c in "xyz"], axis=1)


PARSERS = {".xyz": parse_xyz, ".bin": parse_scan, ".ply": parse_ply}


def parse(path: str, data: bytes) -> np.ndarray:
    if extension(path) not in PARSERS:
        raise ValueError(f"unsupported input format: {path}")
    return PARSERS[extension(path)](data)


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p = parse(path, data.as_buffer().to_pybytes())
                for start in range(0, len(p), 65_536):
                    part = p[start : start + 65_536]
                    ids = np.arange(start, start + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3))], names=["path", "point_id", "x", "y", "z"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """One file as ``point_id, x, y, z``; the format comes from the extension."""
    if extension(path) not in PARSERS:
        raise ValueError(f"unsupported input format: {path}")
    return _parsed(spark.read.format("binaryFile").load(path)).drop("path")


def read_scans(spark: SparkSession, folder: str, pattern: str = "*.bin", stride: int = 1, most: int = 0) -> DataFrame:
    """Many scans as one table with ``path``; every ``stride``-th in path order, ``most`` at the most (0: all)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    chosen = every_nth(files.select("path"), "path", stride, most)
    if chosen.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    ranked = files.join(F.broadcast(chosen), "path")  # a listing
    return _parsed(ranked)


def from_columns(spark: SparkSession, x, y, z) -> DataFrame:
    """A cloud of three equally long sequences."""
    if not len(x) == len(y) == len(z):
        raise ValueError("x, y and z must have the same length")
    columns = {"point_id": pa.array(range(len(x)), pa.int64())} | {n: pa.array(np.asarray(v, np.float32)) for n, v in zip("xyz", (x, y, z), strict=True)}
    return spark.createDataFrame(pa.table(columns), "point_id long, x float, y float, z float")


def append(cloud: DataFrame, more: DataFrame) -> DataFrame:
    """Adds points after those of ``cloud``, with ids that go on from its largest."""
    start = cloud.agg(F.coalesce(F.max("point_id") + 1, F.lit(0))).first()[0]
    return cloud.unionByName(more.withColumn("point_id", F.col("point_id") + start))


def parse_meta(comment: str) -> dict:
    """``key=value`` tokens of a metadata comment; ``sizes`` is a list of numbers."""
    found: dict = {}
    for token in comment.split():
        key, eq, value = token.partition("=")
        if eq:
            found[key] = [int(v) for v in value.split(",") if v] if key == "sizes" else value
    return found


def read_labelled_ply(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """A labelled scene: its metadata and its columns (x, y, z, label and colours)."""
    head = parse_ply_header(data)
    meta = next((m for m in map(parse_meta, head["comments"]) if {"eps", "min_pts"} <= set(m)), None)  # whatever its first word
    if meta is None:
        raise ValueError("the scene has no metadata")
    return meta, ply_vertices(data)
