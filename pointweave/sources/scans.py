"""Selection of scan files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def every_nth(files: DataFrame, path: str = "path", stride: int = 1, most: int = 0) -> DataFrame:
    """Every ``stride``-th path in order, ``most`` at the most (0: all).  A listing, so one window over it is small."""
    if stride < 1 or most < 0:
        raise ValueError("stride must be at least 1 and most not negative")
    ranked = files.select(path, (F.row_number().over(Window.orderBy(path)) - 1).alias("_k")).where(F.col("_k") % stride == 0)
    if most:
        ranked = ranked.where(F.floor(F.col("_k") / stride) < most)
    return ranked.drop("_k")
