"""Lineage cuts: intermediate tables in the folder that all executors share.

``cut`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that an iterative plan neither
grows nor depends on any single executor's disk.  Parquet is used rather than RDD checkpoints because the columnar form
is several times smaller for the narrow integer tables that get cut here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is set only where none is configured (local tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointweave-"))
    return sc.getCheckpointDir()


#: Rows of an Arrow batch while a table is cut: batches of long texts stay small on both sides of a Python worker.
BATCH = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` in the shared folder and return a DataFrame that scans it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pointweave/{name}-{uuid.uuid4().hex}"
    context, rows = spark.sparkContext, spark.conf.get(_BATCH_KEY)
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(f"pointweave: {name}")  # what the status page calls the step
    spark.conf.set(_BATCH_KEY, str(min(BATCH, int(rows)) if int(rows) > 0 else BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_KEY, rows)
        context.setLocalProperty("spark.job.description", before)
    out = spark.read.schema(df.schema).parquet(path)
    out._pointweave_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by exchange and merge, never a broadcast.

    Spark guesses the size of a scanned table from its compressed bytes, and would send millions of rows through the driver.
    """
    return df.hint("merge")


def drop(df: DataFrame | None) -> None:
    """Delete a table made by ``cut`` that no later plan reads."""
    path = getattr(df, "_pointweave_path", None)
    if path is None:
        return
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage: heap goes back to the system, and shuffle files of finished steps may go."""
    spark._jvm.System.gc()
