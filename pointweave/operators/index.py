"""The voxel grid as tables: quantised points in Morton order, voxel spans and the 27-neighbour lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.exprs import HALF, OFFSETS, check_parameters, morton_code, voxel_coordinate
from pointweave.plans.lineage import cut


def quantize(points: DataFrame, eps: float) -> DataFrame:
    """Adds ``vx, vy, vz``."""
    check_parameters(eps, 1)
    return points.withColumns({f"v{c}": voxel_coordinate(c, eps) for c in "xyz"})


def with_morton(points: DataFrame, eps: float) -> DataFrame:
    return quantize(points, eps).withColumn("morton_code", morton_code())


def sorted_positions(points: DataFrame, eps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``sorted_pos``: rank by (morton_code, point_id) from 0, within ``keys`` where given.

    Without keys the ranks come from a range exchange and partition offsets (``global_rank``).
    """
    coded = with_morton(points, eps)
    if keys:
        return coded.withColumn("sorted_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("morton_code", "point_id")).cast("long") - 1)
    return global_rank(coded, ["morton_code", "point_id"], "sorted_pos")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: 0-based rank over a whole table by ``order`` (unique), without a window over one partition.

    One range exchange sorts the table; a row's place in its partition is the low part of its generated id, and the
    partitions' counts (one row each) give the offsets.  The sorted rows are cut, so that places cannot shift.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(ranged, "ranked").withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row for each partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_id", "_part", "_place", "_start")


def voxel_spans(points: DataFrame, eps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of points in a voxel: ``voxel_idx, start, len`` and the voxel's code and coordinates.

    One hash aggregate over the points; starts and indices are running sums over voxels, not over points.
    """
    spans = with_morton(points, eps).groupBy(*keys, "morton_code", "vx", "vy", "vz").agg(F.count("*").alias("len"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("morton_code")
        return spans.withColumn("voxel_idx", F.row_number().over(w).cast("long") - 1).withColumn("start", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    ranked = global_rank(spans, ["morton_code"], "voxel_idx")
    # running sum in two steps as well: within blocks of consecutive voxels, then over blocks
    ranked = ranked.withColumn("_b", F.floor(F.col("voxel_idx") / 4096).cast("long"))
    blocks = ranked.groupBy("_b").agg(F.sum("len").alias("_s"))
    offsets = blocks.withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = Window.partitionBy("_b").orderBy("voxel_idx").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_run", F.sum("len").over(w) - F.col("len")).join(offsets, "_b").withColumn("start", (F.col("_o") + F.col("_run")).cast("long")).drop("_b", "_o", "_run")


def neighbor_lut(spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(voxel_idx, slot, neighbor_idx)`` for all 27 slots; a missing or out-of-range neighbour is null."""
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "dz"), o, strict=True)]) for o in OFFSETS])
    probes = spans.select(*keys, "voxel_idx", "vx", "vy", "vz", F.posexplode(offsets).alias("slot", "o"))
    probes = probes.select(*keys, "voxel_idx", "slot", *[(F.col(f"v{c}") + F.col(f"o.d{c}")).alias(f"v{c}") for c in "xyz"])
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(f"v{c}").between(-HALF, HALF - 1)
    there = spans.select(*keys, "vx", "vy", "vz", F.col("voxel_idx").alias("neighbor_idx"))
    keyed = probes.withColumns({f"v{c}": F.when(inside, F.col(f"v{c}")) for c in "xyz"})
    return keyed.join(there, [*keys, "vx", "vy", "vz"], "left").select(*keys, "voxel_idx", "slot", "neighbor_idx")


def occupancy(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("n_voxels"), F.avg("len").alias("avg_len"), F.coalesce(F.max("len"), F.lit(0)).alias("max_len"))
