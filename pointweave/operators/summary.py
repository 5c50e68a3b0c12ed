"""Summaries of labelled clouds, and the comparison of a clustering with expected sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_sizes(labelled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return labelled.where("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("size"))


def cluster_summary(labelled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key): points, clusters (the highest label), distinct labels above 0, noise, mean size."""
    aggregates = [
        F.count("*").alias("points"),
        F.coalesce(F.max("label"), F.lit(0)).alias("clusters"),
        F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("distinct_clusters"),
        F.count_if(F.col("label") == 0).alias("noise"),
    ]
    return labelled.groupBy(*keys).agg(*aggregates) if keys else labelled.agg(*aggregates)


def size_profile(labelled: DataFrame) -> DataFrame:
    """Sorted cluster sizes as an array and as text; one entry for each cluster."""
    sizes = cluster_sizes(labelled).agg(F.array_sort(F.collect_list("size")).alias("sizes"))
    return sizes.select("sizes", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes_text"))


def bounding_box(points: DataFrame, margin: float = 0.0) -> DataFrame:
    return points.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]).select(
        *[(F.col(f"{n}_{c}") + F.lit(sign * margin)).alias(f"{n}_{c}") for c in "xyz" for n, sign in (("min", -1.0), ("max", 1.0))]
    )


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in "xyz"])


def recentre(points: DataFrame) -> DataFrame:
    """Moves the cloud's centroid to the origin; the centroid is a single broadcast row."""
    middle = centroid(points)
    return points.join(F.broadcast(middle)).withColumns({c: F.col(c) - F.col(f"mean_{c}").cast("float") for c in "xyz"}).drop("mean_x", "mean_y", "mean_z")


def compare_sizes(found: DataFrame, expected: DataFrame, noise_found: int, noise_expected: int, size_slack: int = 5, noise_share: float = 0.05) -> dict:
    """Cluster counts must agree, noise within max(5, 5 %), and each sorted size within ``size_slack``.

    ``found`` and ``expected`` are tables with a ``size`` column.
    """

    def ranked(df, name):
        return df.select(F.row_number().over(Window.orderBy("size")).alias("k"), F.col("size").alias(name))

    joined = ranked(found, "f").join(ranked(expected, "e"), "k", "full")
    row = joined.agg(F.count("f").alias("n_found"), F.count("e").alias("n_expected"), F.coalesce(F.count_if(F.abs(F.col("f") - F.col("e")) > size_slack), F.lit(0)).alias("off")).first()
    return {
        "clusters_match": row["n_found"] == row["n_expected"],
        "noise_match": abs(noise_found - noise_expected) <= max(5, noise_share * noise_expected),
        "sizes_match": row["n_found"] == row["n_expected"] and row["off"] == 0,
    }


def first_position(sorted_points: DataFrame, x: float) -> DataFrame:
    return sorted_points.where(F.col("x") == F.lit(x).cast("float")).agg(F.min("sorted_pos").alias("sorted_pos"))


def label_map_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinate-to-label rows that only one of two clusterings has."""
    c = ["x", "y", "z", "label"]
    return a.select(*c).exceptAll(b.select(*c)).union(b.select(*c).exceptAll(a.select(*c)))
