"""Pyramids by strided sampling, their scales, and label growth in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..planner import strides


def pyramid(voxels: DataFrame, axes: Sequence[str], n_levels: int = 5, downscale: int = 2) -> DataFrame:
    """All levels from one scan: level and the voxels whose in-plane coordinates are multiples of its stride.

    Level i of level i - 1 is level 0 with the stride to the power i, so each
    voxel goes straight to every level that keeps it. Always ``n_levels``
    levels, level 0 among them.
    """
    if n_levels < 1 or downscale < 2:
        raise ValueError("a pyramid needs at least one level and a downscale of 2 or more")
    plane = [a for a, s in zip(axes, strides("".join(axes), downscale)) if s > 1]
    rows = voxels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))))
    step = F.pow(F.lit(float(downscale)), F.col("level")).cast("int")
    if plane:
        rows = rows.filter(reduce(lambda x, y: x & y, [F.col(a) % step == 0 for a in plane]))
    for a in plane:
        rows = rows.withColumn(a, F.floor(F.col(a) / step).cast("int"))
    return rows


def pyramid_meta(spark, shape: Sequence[int], axes: Sequence[str], scale: dict[str, float], n_levels: int = 5, downscale: int = 2, unit: str = "micrometer") -> DataFrame:
    """level, axis, size, scale, unit of every level; uncalibrated axes have scale 1."""
    rows = []
    for level in range(n_levels):
        for a, s, k in zip(axes, shape, strides("".join(axes), downscale)):
            rows.append((level, a, -(-s // k**level), float(scale.get(a, 1.0)) * k**level, unit if a in "zyx" else None))
    return spark.createDataFrame(rows, "level int, axis string, size int, scale double, unit string")


def ngff_attributes(meta: DataFrame, name: str, version: str = "0.4") -> DataFrame:
    """One row: the multiscales document of a pyramid as JSON, at top level (0.4) or under ``ome`` (0.5)."""
    place = F.array_position(F.array(*map(F.lit, "tczyx")), F.col("axis"))
    kind = F.when(F.col("axis").isin("z", "y", "x"), "space").when(F.col("axis") == "t", "time").otherwise("channel")
    axis = F.struct(F.col("axis").alias("name"), kind.alias("type"), "unit")
    level = meta.groupBy("level").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "scale", axis.alias("a")))).alias("s"))
    scale = F.struct(F.lit("scale").alias("type"), F.col("s.scale").alias("scale"))
    dataset = F.struct(F.col("level").cast("string").alias("path"), F.array(scale).alias("coordinateTransformations"))
    image = level.agg(
        F.min_by(F.col("s.a"), "level").alias("axes"), F.transform(F.array_sort(F.collect_list(F.struct("level", dataset.alias("d")))), lambda x: x["d"]).alias("datasets")
    )
    scales = F.struct(F.lit(name).alias("name"), "axes", "datasets")
    body = F.struct(F.array(scales).alias("multiscales")) if version == "0.4" else F.struct(F.struct(F.lit(version).alias("version"), F.array(scales).alias("multiscales")).alias("ome"))
    return image.select(F.to_json(body).alias("attributes"))


def grow(labels: DataFrame, axes: Sequence[str], shape: Sequence[int], iterations: int = 1, label: str = "label") -> DataFrame:
    """Labels grown by a box of side 2 * iterations + 1, clipped to the image; where they collide the larger wins.

    One axis after another: a maximum over a box is a maximum per axis, so
    each voxel is copied 2 * iterations + 1 times per axis rather than to the
    power of the axes.
    """
    rows = labels.filter(F.col(label) > 0).select(*axes, label)
    for a, s in zip(axes, shape) if iterations > 0 else ():
        near = F.explode(F.sequence(F.greatest(F.col(a) - iterations, F.lit(0)), F.least(F.col(a) + iterations, F.lit(s - 1))))
        rows = rows.withColumn(a, near).withColumn(a, F.col(a).cast("int")).groupBy(*axes).agg(F.max(label).alias(label))
    return rows


def smooth(voxels: DataFrame, axes: Sequence[str], shape: Sequence[int], sigma: float, value: str = "value", truncate: float = 4.0) -> DataFrame:
    """Gaussian in long form, axis by axis, mirrored at the edges; absent voxels count as 0."""
    from .kernels import gaussian_weights

    w = gaussian_weights(sigma, truncate).tolist()
    r = len(w) // 2
    taps = F.array(*(F.struct(F.lit(i - r).alias("d"), F.lit(x).alias("w")) for i, x in enumerate(w)))
    rows = voxels.select(*axes, F.col(value).cast("double").alias("value"))
    for a, s in zip(axes, shape):
        # A source voxel reaches p + d, and through the mirror at either edge.
        p = F.col(a)
        images = F.array(p, -p - 1, F.lit(2 * s - 1) - p)
        rows = rows.select(*axes, "value", F.explode(images).alias("_p")).select(*[c for c in axes if c != a], "value", "_p", F.explode(taps).alias("_k"))
        rows = rows.withColumn(a, (F.col("_p") + F.col("_k.d")).cast("int")).filter((F.col(a) >= 0) & (F.col(a) < s))
        rows = rows.groupBy(*axes).agg(F.sum(F.col("value") * F.col("_k.w")).alias("value"))
    return rows


def dog(voxels: DataFrame, axes: Sequence[str], shape: Sequence[int], low_sigma: float, high_sigma: float, value: str = "value") -> DataFrame:
    """Difference of two Gaussians: the axes and response."""
    low = smooth(voxels, axes, shape, low_sigma, value)
    high = smooth(voxels, axes, shape, high_sigma, value).withColumnRenamed("value", "_high")
    return low.join(high, list(axes), "full").select(*axes, (F.coalesce("value", F.lit(0.0)) - F.coalesce("_high", F.lit(0.0))).alias("response"))
