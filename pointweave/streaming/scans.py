"""Cluster each scan file as it arrives: ``binaryFile`` stream, one micro-batch for the new files, scans kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointweave.operators.dbscan import dbscan
from pointweave.sources.clouds import _parsed


def cluster_scans(spark: SparkSession, folder: str, output: str, checkpoint: str, eps: float, min_pts: int, pattern: str = "*.bin") -> StreamingQuery:
    """Writes ``path, scan_point, x, y, z, is_core, label`` for every new file to Parquet under ``output``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        points = _parsed(batch).select("path", F.col("point_id").alias("scan_point"), "x", "y", "z").withColumn("point_id", F.monotonically_increasing_id())
        from pointweave.plans.lineage import cut

        points = cut(points, "scan")
        found = dbscan(points, eps, min_pts, "path").join(points.select("point_id", "scan_point"), "point_id").drop("point_id")
        found.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")  # a repeated batch replaces itself

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
