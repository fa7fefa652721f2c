"""Tile assignment, halos and tile faces as projections and equi-keys; no range join anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import ImageMeta


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def div(c: Column, n: int) -> Column:
    """Integer division of a non-negative coordinate."""
    return F.floor(c / F.lit(n)).cast("int")


def tile_id(meta: ImageMeta) -> Column:
    """The row-major number of the tile that holds a voxel."""
    return _sum([div(F.col(a), t).cast("bigint") * k for a, t, k in zip(meta.axes, meta.tile, meta.tile_steps)])


def voxel_id(meta: ImageMeta) -> Column:
    """The row-major number of a voxel in the whole image."""
    return _sum([F.col(a).cast("bigint") * k for a, k in zip(meta.axes, meta.voxel_steps)])


def assign_tiles(voxels: DataFrame, meta: ImageMeta) -> DataFrame:
    return voxels.withColumn("tile_id", tile_id(meta))


def tile_grid(spark: SparkSession, meta: ImageMeta) -> DataFrame:
    """One row per tile in row-major order: tile_id, and per axis the tile index and its half-open box."""
    rest = F.col("tile_id")
    out = spark.range(meta.n_tiles).select(F.col("id").alias("tile_id"))
    for a, s, t, k, g in zip(meta.axes, meta.shape, meta.tile, meta.tile_steps, meta.grid):
        i = (F.floor(rest / k) % g).cast("int")
        out = out.withColumn(f"t{a}", i).withColumn(f"{a}_lo", i * t).withColumn(f"{a}_hi", F.least(i * t + t, F.lit(s)).cast("int"))
    return out


def region(voxels: DataFrame, meta: ImageMeta, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """The voxels of a half-open box, clipped to the image; plain comparisons that reach the scan."""
    for a, s, x, y in zip(meta.axes, meta.shape, lo, hi):
        voxels = voxels.filter((F.col(a) >= max(0, x)) & (F.col(a) < min(s, y)))
    return voxels


def assign_halo(voxels: DataFrame, meta: ImageMeta) -> DataFrame:
    """Each voxel once per tile whose haloed box holds it: tile_id and is_core.

    The covered tile indices of an axis are a short sequence around the voxel,
    clipped to the grid before dividing; the halo must be narrower than a tile
    times the number of copies that one is ready to make.
    """
    out = voxels
    for a, s, t, h in zip(meta.axes, meta.shape, meta.tile, meta.halo):
        p = F.col(a)
        if h:
            first, last = div(F.greatest(p - h, F.lit(0)), t), div(F.least(p + h, F.lit(s - 1)), t)
            out = out.withColumn(f"_t{a}", F.explode(F.sequence(first, last)))
        else:
            out = out.withColumn(f"_t{a}", div(p, t))
    where = _sum([F.col(f"_t{a}").cast("bigint") * k for a, k in zip(meta.axes, meta.tile_steps)])
    core = reduce(lambda x, y: x & y, [F.col(f"_t{a}") == div(F.col(a), t) for a, t in zip(meta.axes, meta.tile)])
    return out.withColumn("tile_id", where).withColumn("is_core", core).drop(*(f"_t{a}" for a in meta.axes))


def centred_window(voxels: DataFrame, meta: ImageMeta, window: Sequence[int]) -> DataFrame:
    """The voxels within a window centred in their tile and clamped to it; the window aligns to the last axes."""
    sizes = (list(window)[-len(meta.axes) :] if len(window) >= len(meta.axes) else list(meta.tile[: len(meta.axes) - len(window)]) + list(window))
    for a, s, t, w in zip(meta.axes, meta.shape, meta.tile, sizes):
        lo = div(F.col(a), t) * t
        hi = F.least(lo + t, F.lit(s))
        w = min(w, t)
        start = F.greatest(lo, F.least(lo + F.floor((hi - lo - w) / 2), hi - w))
        voxels = voxels.filter((F.col(a) >= start) & (F.col(a) < F.least(start + w, hi)))
    return voxels
