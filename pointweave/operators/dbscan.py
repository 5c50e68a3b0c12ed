"""Density clustering as a distributed plan.

    points -> collapse equal coordinates -> voxel grid -> tiles of cells, each with the two cells around it, clustered by
           themselves (kernel.py) -> connected components of the tiles' parts of clusters, by sites along their sides
           -> rank of components by the Morton position of their first core point -> lowest label for border sites
           -> labels joined back to points

Where the smallest tile would hold too many sites the middle of the plan is relational:

    voxel grid -> half-neighbourhood equi-join with an exact float32 residual -> neighbour sums (core test)
           -> connected components of core sites -> rank of components -> lowest label for border sites

A point is *core* when at least ``min_pts`` points, itself included, lie within ``eps`` (inclusive).  Clusters are the
components of the core points; clusters are numbered from 1 in Morton order of their first core point, border points
take the lowest cluster number among their core neighbours, everything else is 0.

A cloud (or one value of ``partition_by``) of at most ``task_points`` rows, a checked number, is clustered inside one task
(kernel.py), so many scans run side by side without an exchange but the one that gathers each; larger ones follow the plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.exprs import HALF_OFFSETS, check_parameters, f32, is_finite, morton_code, squared_distance, squared_radius, voxel_coordinate
from pointweave.operators.components import connected_components
from pointweave.operators.index import global_rank
from pointweave.operators.kernel import cluster, tile, union
from pointweave.plans.lineage import BATCH, cut, drop, shuffled, tidy

#: Up to this many core-core edges (16 bytes each) the components are found by one task; beyond it in rounds of joins.
DRIVER_EDGES = 1_000_000
#: Rows of a cloud (20 bytes each) that one task clusters by itself.
TASK_POINTS = 250_000
#: Sides of tiles that are tried, as powers of two cells (8 at least), and the sites of a tile with its surroundings.
TILE_BITS, TILE_SITES = (6, 5, 4, 3), 250_000


def sites(points: DataFrame, eps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct finite coordinates with their multiplicity ``w`` and smallest ``point_id`` as ``site``."""
    kept = points.where(is_finite("x", "y", "z")).select(*keys, "point_id", *[F.col(c).cast("float").alias(c) for c in "xyz"])
    one = kept.groupBy(*keys, "x", "y", "z").agg(F.count("*").alias("w"), F.min("point_id").alias("site"))
    return one.withColumns({f"v{c}": voxel_coordinate(c, eps) for c in "xyz"})


def site_pairs(grid: DataFrame, eps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each unordered pair of distinct sites within ``eps`` once: keys, a, wa, b, wb.

    One side is repeated for the 14 cells of the half neighbourhood, so the join is a plain equi-join on the cell.
    """
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "dz"), o, strict=True)]) for o in HALF_OFFSETS])
    point = F.struct("site", "w", "x", "y", "z")
    left = grid.select(*keys, point.alias("p"), "vx", "vy", "vz", F.explode(offsets).alias("o"))
    left = left.select(*keys, "p", *[(F.col(f"v{c}") + F.col(f"o.d{c}")).alias(f"v{c}") for c in "xyz"], ((F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)).alias("own"))
    right = grid.select(*keys, point.alias("q"), "vx", "vy", "vz")
    near = (squared_distance("p", "q") <= f32(squared_radius(eps))) & (~F.col("own") | (F.col("p.site") < F.col("q.site")))
    joined = left.join(shuffled(right), [*keys, "vx", "vy", "vz"]).where(near)
    return joined.select(*keys, F.col("p.site").alias("a"), F.col("p.w").alias("wa"), F.col("q.site").alias("b"), F.col("q.w").alias("wb"))


def epsilon_pairs(points: DataFrame, eps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unordered point pairs within ``eps``; points without a finite coordinate have none."""
    check_parameters(eps, 1)
    kept = points.where(is_finite("x", "y", "z")).select(*keys, F.col("point_id").alias("site"), F.lit(1).cast("long").alias("w"), *[F.col(c).cast("float").alias(c) for c in "xyz"])
    grid = kept.withColumns({f"v{c}": voxel_coordinate(c, eps) for c in "xyz"})
    return site_pairs(grid, eps, keys).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def neighbor_counts(grid: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Grid rows with ``n``: points within eps of the site, its own included."""
    both = pairs.select(*keys, F.col("a").alias("site"), F.col("wb").alias("m")).union(pairs.select(*keys, F.col("b").alias("site"), F.col("wa").alias("m")))
    near = both.groupBy(*keys, "site").agg(F.sum("m").alias("m"))
    return grid.join(shuffled(near), [*keys, "site"], "left").withColumn("n", F.col("w") + F.coalesce("m", F.lit(0))).drop("m")


def _union_find(edges: DataFrame) -> DataFrame:
    """Components in one task, for an edge table whose size has been checked; neither edges nor nodes reach the driver."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            ends = np.stack([np.concatenate(c) for c in zip(*got, strict=True)])
            nodes, flat = np.unique(ends, return_inverse=True)
            u, v = flat.reshape(2, -1)
            component = nodes[union(np.arange(len(nodes)), u, v)]
            for k in range(0, len(nodes), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH], pa.int64()) for c in (nodes, component)], names=["node", "component"])

    return cut(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long"), "parts")


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    if driver_edges and edges.limit(driver_edges + 1).count() <= driver_edges:
        return _union_find(edges)
    return connected_components(edges)


def _numbered(first: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``root, label`` for keys, root, code, least_id: numbers from 1 within the keys, by code and least_id."""
    ranked = global_rank(first, [*keys, "code", "least_id", "root"], "rank")
    if keys:  # ranks of a key follow each other
        starts = ranked.groupBy(*keys).agg(F.min("rank").alias("start"))
        ranked = ranked.join(starts, list(keys)).withColumn("rank", F.col("rank") - F.col("start"))
    return ranked.select("root", (F.col("rank") + 1).alias("label"))


def in_tiles(grid: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, int] | None:
    """``grid`` with tx, ty, tz, a row once more for each tile whose two cells around it hold the site, and a tile's side in cells.

    None if some tile of the smallest side has more than TILE_SITES rows.
    """
    for bits in TILE_BITS:
        side, tiles = 1 << bits, grid
        for c in "xyz":
            cell = F.col(f"v{c}") + F.lit(side // 2)  # zero, where many clouds begin, is in the middle of a tile
            own, at = F.shiftright(cell, bits), cell.bitwiseAND(F.lit(side - 1))
            near = F.when(at < 2, F.array(own, own - 1)).when(at >= side - 2, F.array(own, own + 1)).otherwise(F.array(own))
            tiles = tiles.withColumn(f"t{c}", F.explode(near))
        if (tiles.groupBy(*keys, "tx", "ty", "tz").count().agg(F.max("count")).first()[0] or 0) <= TILE_SITES:
            return tiles, side
    return None


def _labels_by_tile(grid: DataFrame, tiles: DataFrame, side: int, eps: float, min_pts: int, keys: tuple[str, ...], driver_edges: int) -> DataFrame:
    """``site_labels`` from tiles; every row of ``got`` is one of four kinds (see ``kernel.tile``)."""
    columns = {"kind": "string", "a": "long", "b": "long", "code": "long", "x": "float", "y": "float", "z": "float", "is_core": "boolean"}
    schema = grid.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in columns.items()]).schema
    holds = {"noise": ("x", "y", "z"), "held": ("x", "y", "z", "is_core", "a"), "links": ("a", "b"), "first": ("a", "code", "b")}
    kinds = {"string": pa.string(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_()}

    def run(t: pa.Table) -> pa.Table:
        place = np.stack([t.column(f"v{c}").to_numpy().astype(np.int64) + side // 2 - t.column(f"t{c}").to_numpy().astype(np.int64) * side for c in "xyz"], axis=1)
        made = {}
        if ((place >= 0) & (place < side)).all(1).any():
            xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
            made = tile(xyz, *[t.column(c).fill_null(0).to_numpy() for c in ("site", "w", "least_id")], place, side, eps, min_pts)
        parts = []
        for kind, arrays in made.items():
            n, has = len(arrays[0]), dict(zip(holds[kind], arrays, strict=True))
            of_kind = {"kind": pa.array([kind]).take(pa.array(np.zeros(n, np.int64)))} | {c: pa.array(has[c], kinds[columns[c]]) if c in has else pa.nulls(n, kinds[columns[c]]) for c in columns if c != "kind"}
            parts.append(pa.table({k: t.column(k).take(pa.array(np.zeros(n, np.int64))) for k in keys} | of_kind))
        return pa.concat_tables(parts) if parts else pa.table({k: t.column(k).slice(0, 0) for k in keys} | {c: pa.nulls(0, kinds[x]) for c, x in columns.items()})

    got = cut(tiles.groupBy(*keys, "tx", "ty", "tz").applyInArrow(run, schema), "pairs")
    tidy(grid.sparkSession)
    linked = cut(got.where("kind = 'links'").select("a", "b").distinct(), "links")
    parts = components(linked, driver_edges)
    first = got.where("kind = 'first'").select(*keys, F.col("a").alias("node"), "code", F.col("b").alias("least_id"))
    # a node's component is its smallest, so a part without links is one by itself
    rooted = parts.select("node", "component").union(first.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("root"))
    rooted = cut(rooted, "core")
    tidy(grid.sparkSession)
    least = first.join(shuffled(rooted), "node").groupBy(*keys, "root").agg(F.min(F.struct("code", "least_id")).alias("first"))
    numbered = _numbered(least.select(*keys, "root", "first.code", "first.least_id"), keys)
    labelled = cut(rooted.join(shuffled(numbered), "root").select("node", "label"), "core-labels")
    held = got.where("kind = 'held'").select(*keys, "x", "y", "z", "is_core", F.col("a").alias("node"))
    known = held.join(shuffled(labelled), "node").groupBy(*keys, "x", "y", "z").agg(F.first("is_core").alias("is_core"), F.min("label").alias("label"))
    noise = got.where("kind = 'noise'").select(*keys, "x", "y", "z", F.lit(False).alias("is_core"), F.lit(0).cast("long").alias("label"))
    found = cut(known.union(noise), "site-labels")
    for t in (grid, got, linked, parts, rooted, labelled):
        drop(t)
    tidy(grid.sparkSession)
    return found


def site_labels(points: DataFrame, eps: float, min_pts: int, keys: tuple[str, ...] = (), driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Per distinct coordinate: keys, x, y, z, is_core, label.

    ``site`` is a number of its own here, unique over all keys: point ids may repeat from key to key.
    """
    grid = sites(points, eps, keys).withColumnRenamed("site", "least_id").withColumn("site", F.monotonically_increasing_id())
    grid = cut(grid, "sites")  # written once, so the numbers stay
    if tiled := in_tiles(grid, keys):
        return _labels_by_tile(grid, *tiled, eps, min_pts, keys, driver_edges)
    pairs = cut(site_pairs(grid, eps, keys).select("a", "wa", "b", "wb"), "pairs")
    flagged = cut(neighbor_counts(grid, pairs).withColumn("is_core", F.col("n") >= min_pts), "core")
    core = flagged.where("is_core").select("site", morton_code().alias("code"), "least_id", *keys)
    ids = core.select("site")
    linked = cut(pairs.join(shuffled(ids.withColumnRenamed("site", "a")), "a", "left_semi").join(shuffled(ids.withColumnRenamed("site", "b")), "b", "left_semi").select("a", "b"), "links")
    parts = components(linked, driver_edges)
    rooted = core.join(shuffled(parts), core.site == parts.node, "left").select(*keys, "site", "code", "least_id", F.coalesce("component", "site").alias("root"))
    first = rooted.groupBy(*keys, "root").agg(F.min(F.struct("code", "least_id")).alias("first"))
    numbered = _numbered(first.select(*keys, "root", "first.code", "first.least_id"), keys)
    labelled = cut(rooted.join(shuffled(numbered), "root").select("site", "label"), "core-labels")
    ends = pairs.select(F.col("a").alias("site"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("site"), F.col("a").alias("other")))
    rest = flagged.where("not is_core").select("site")
    border = ends.join(shuffled(rest), "site", "left_semi").join(shuffled(labelled.withColumnRenamed("site", "other")), "other").groupBy("site").agg(F.min("label").alias("label"))
    known = labelled.union(border)
    found = cut(flagged.join(shuffled(known), "site", "left").select(*keys, "x", "y", "z", "is_core", F.coalesce("label", F.lit(0).cast("long")).alias("label")), "site-labels")
    for t in (grid, pairs, flagged, linked, parts, labelled):
        drop(t)
    return found


def _in_tasks(cloud: DataFrame, eps: float, min_pts: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each key's rows (or all rows) in one task."""
    schema = cloud.withColumns({"is_core": F.lit(False), "label": F.lit(0).cast("long")}).schema

    def run(t: pa.Table) -> pa.Table:
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1).astype(np.float32)  # null: NaN
        ids = t.column("point_id").fill_null(0).to_numpy()
        is_core, label = cluster(xyz, ids, eps, min_pts)
        return t.append_column("is_core", pa.array(is_core)).append_column("label", pa.array(label))

    return cloud.groupBy(*keys).applyInArrow(run, schema)


def _by_plan(cloud: DataFrame, eps: float, min_pts: int, keys: tuple[str, ...], driver_edges: int) -> DataFrame:
    found = site_labels(cloud, eps, min_pts, keys, driver_edges)
    ok = cloud.where(is_finite("x", "y", "z")).join(shuffled(found), [*keys, "x", "y", "z"], "left")
    odd = cloud.where(~is_finite("x", "y", "z")).withColumns({"is_core": F.lit(False), "label": F.lit(0).cast("long")})
    columns = [*keys, "point_id", "x", "y", "z", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("label", F.lit(0).cast("long")).alias("label")]
    return ok.select(*columns).union(odd.select(*columns))


def dbscan(points: DataFrame, eps: float, min_pts: int, partition_by: str | None = None, driver_edges: int = DRIVER_EDGES, task_points: int = TASK_POINTS) -> DataFrame:
    """Labels every row of ``points`` (point_id BIGINT unique, x, y, z; further columns are ignored).

    Returns ``[partition_by,] point_id, x, y, z, is_core, label``.  Rows with a null or non-finite coordinate are noise.
    ``partition_by`` clusters each of its values apart (null is one of them); ids need to be unique only within a value.
    ``task_points`` 0 sends every cloud through the distributed plan.
    """
    check_parameters(eps, min_pts)
    xyz = [F.col(c).cast("float").alias(c) for c in "xyz"]
    if not partition_by:
        cloud = points.select(F.col("point_id").cast("long").alias("point_id"), *xyz)
        if task_points and cloud.limit(task_points + 1).count() <= task_points:
            return _in_tasks(cloud, eps, min_pts).select("point_id", "x", "y", "z", "is_core", "label")
        return _by_plan(cloud, eps, min_pts, (), driver_edges)
    # a struct, so that null is a key like any other
    cloud = points.select(F.struct(F.col(partition_by).alias("v")).alias("_key"), F.col("point_id").cast("long").alias("point_id"), *xyz)
    columns = [F.col("_key.v").alias(partition_by), "point_id", "x", "y", "z", "is_core", "label"]
    if not task_points:
        return _by_plan(cloud, eps, min_pts, ("_key",), driver_edges).select(*columns)
    large = cut(cloud.groupBy("_key").count().where(F.col("count") > task_points).select("_key"), "large-keys")
    if large.isEmpty():
        return _in_tasks(cloud, eps, min_pts, ("_key",)).select(*columns)
    small = _in_tasks(cloud.join(large, "_key", "left_anti"), eps, min_pts, ("_key",))
    rest = _by_plan(cloud.join(large, "_key", "left_semi"), eps, min_pts, ("_key",), driver_edges)
    return small.select(*columns).union(rest.select(*columns))
