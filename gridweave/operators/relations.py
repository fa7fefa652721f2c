"""Relations between two labelings, and measurements per object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_counts(a: DataFrame, b: DataFrame, axes: Sequence[str], label: str = "label") -> DataFrame:
    """a_id, b_id, n of labels that share voxels; an equi-join on the coordinates, counted with partial sums."""
    left = a.filter(F.col(label) > 0).select(*axes, F.col(label).cast("bigint").alias("a_id"))
    right = b.filter(F.col(label) > 0).select(*axes, F.col(label).cast("bigint").alias("b_id"))
    return left.join(right, list(axes)).groupBy("a_id", "b_id").agg(F.count("*").alias("n"))


def label_relations(a: DataFrame, b: DataFrame, axes: Sequence[str], denominator: str = "matched", label: str = "label") -> DataFrame:
    """For each a with an overlap its greatest b: a_id, match, overlap_voxels, overlap_fraction.

    Equal overlaps go to the least b. The fraction is of the voxels of a that
    lie in any b (``matched``) or of all its voxels (``total``).
    """
    return best_matches(overlap_counts(a, b, axes, label), a if denominator == "total" else None, denominator, label)


def best_matches(counts: DataFrame, a: DataFrame | None = None, denominator: str = "matched", label: str = "label") -> DataFrame:
    """``label_relations`` from counted overlaps (a_id, b_id, n); ``a`` holds the voxels of a for the denominator ``total``."""
    best = counts.groupBy("a_id").agg(F.max_by(F.struct("b_id", "n"), F.struct("n", -F.col("b_id"))).alias("m"), F.sum("n").alias("all"))
    if denominator == "total":
        size = a.filter(F.col(label) > 0).groupBy(F.col(label).cast("bigint").alias("a_id")).agg(F.count("*").alias("size"))
        best = best.join(size, "a_id").withColumn("all", F.col("size"))
    elif denominator != "matched":
        raise ValueError("denominator is 'matched' or 'total'")
    return best.select("a_id", F.col("m.b_id").alias("match"), F.col("m.n").alias("overlap_voxels"), (F.col("m.n") / F.col("all")).alias("overlap_fraction"))


def label_ids(labels: DataFrame, label: str = "label", n_objects: int | None = None) -> DataFrame:
    """The ids of a labeling: 1..n_objects if that count is known, without a scan, else the distinct labels."""
    if n_objects is not None:
        return labels.sparkSession.range(1, n_objects + 1).select(F.col("id"))
    return labels.filter(F.col(label) > 0).select(F.col(label).cast("bigint").alias("id")).distinct()


def relations_per_a(a_ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Every a, also those without a match (null, 0, 0)."""
    return a_ids.select(F.col("id").alias("a_id")).join(relations, "a_id", "left").select(
        "a_id", "match", F.coalesce("overlap_voxels", F.lit(0)).alias("overlap_voxels"), F.coalesce("overlap_fraction", F.lit(0.0)).alias("overlap_fraction")
    )


def relations_per_b(b_ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Every b with the number of a that match it and their overlap."""
    n = relations.groupBy(F.col("match").alias("b_id")).agg(F.count("*").alias("n_a"), F.sum("overlap_voxels").alias("overlap_voxels"))
    return b_ids.select(F.col("id").alias("b_id")).join(n, "b_id", "left").select(
        "b_id", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("overlap_voxels", F.lit(0)).alias("overlap_voxels")
    )


def unmatched(a_ids: DataFrame, relations: DataFrame) -> DataFrame:
    return a_ids.select(F.col("id").alias("a_id")).join(relations.select("a_id"), "a_id", "left_anti")


def region_props(labels: DataFrame, image: DataFrame, axes: Sequence[str], label: str = "label", value: str = "value") -> DataFrame:
    """Per label: voxels, sum and mean and population deviation of the image, centroid and bounding box."""
    rows = labels.filter(F.col(label) > 0).join(image.select(*axes, F.col(value).alias("_v")), list(axes), "left")
    return rows.groupBy(F.col(label).cast("bigint").alias("label")).agg(
        F.count("*").alias("area"), F.sum("_v").cast("bigint").alias("total"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"),
        *(F.avg(a).alias(f"{a}_mean") for a in axes), *(F.min(a).alias(f"{a}_min") for a in axes), *(F.max(a).alias(f"{a}_max") for a in axes),
    )
