"""Empty-tile detection: max-pooled maps, exact and sampled tile occupancy, Otsu thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import ImageMeta
from ..planner import sampling_windows, tile_box
from ..runtime import materialize, small
from . import grid

#: Tiles whose windows give the threshold of a sampled map, the first ones in tile order.
SAMPLED_TILES = 500


def block_max(voxels: DataFrame, axes: Sequence[str], block: Sequence[int], value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Greatest value per brick: ``keep`` columns (as the channel), b<axis> per axis, vmax. Partial maxima come before the shuffle."""
    bricks = [grid.div(F.col(a), b).alias(f"b{a}") for a, b in zip(axes, block)]
    return voxels.groupBy(*keep, *bricks).agg(F.max(value).alias("vmax"))


def tile_occupancy(bricks: DataFrame, meta: ImageMeta, block: Sequence[int], threshold: float) -> DataFrame:
    """tile_id, vmax, occupied of every tile that a brick touches: the greatest covering brick exceeds the threshold.

    Each brick is sent to the few tiles that it overlaps, so the interval join
    is an explode. A brick shared by two tiles counts for both: a tile may be
    kept needlessly, none is lost.
    """
    out = bricks
    for a, s, t, b in zip(meta.axes, meta.shape, meta.tile, block):
        first = grid.div(F.col(f"b{a}") * b, t)
        last = grid.div(F.least(F.col(f"b{a}") * b + (b - 1), F.lit(s - 1)), t)
        out = out.withColumn(f"_t{a}", F.explode(F.sequence(first, last)))
    where = reduce(lambda x, y: x + y, [F.col(f"_t{a}").cast("bigint") * k for a, k in zip(meta.axes, meta.tile_steps)])
    return out.groupBy(where.alias("tile_id")).agg(F.max("vmax").alias("vmax")).withColumn("occupied", F.col("vmax") > threshold)


def window_box(meta: ImageMeta, tile: int, window: Sequence[int]) -> list[tuple[int, int]]:
    """The window of a tile as ``grid.centred_window`` cuts it, as half-open ranges."""
    sizes = list(window)[-len(meta.axes) :] if len(window) >= len(meta.axes) else [*meta.tile[: len(meta.axes) - len(window)], *window]
    out = []
    for (lo, hi), t, w in zip(tile_box(meta.shape, meta.tile, tile), meta.tile, sizes):
        start = max(lo, min(lo + (hi - lo - min(w, t)) // 2, hi - min(w, t)))
        out.append((start, min(start + min(w, t), hi)))
    return out


def sampled_threshold(voxels: DataFrame, meta: ImageMeta, window: Sequence[int] = (24, 256, 256), value: str = "value", most: int = SAMPLED_TILES) -> DataFrame:
    """Otsu's threshold of the windows of the first ``most`` tiles; absent voxels of a window count as zeros."""
    n = min(most, meta.n_tiles)
    volume = sum(prod(y - x for x, y in window_box(meta, t, window)) for t in range(n))
    rows = grid.assign_tiles(grid.centred_window(voxels, meta, window), meta).filter(F.col("tile_id") < n).select(value, F.lit(1).cast("bigint").alias("_n"))
    zero = F.lit(0).cast(voxels.schema[value].dataType)
    absent = rows.agg((F.lit(volume).cast("bigint") - F.count("*")).alias("_n")).filter("_n > 0").select(zero.alias(value), "_n")
    return otsu(histogram(rows.unionByName(absent), value, count="_n"))


def sampled_occupancy(voxels: DataFrame, meta: ImageMeta, window: Sequence[int] = (24, 256, 256), threshold: float | None = 0.0, value: str = "value") -> DataFrame:
    """tile_id, vmax, occupied from a window centred in each tile; tiles without a voxel in it are missing.

    Without a threshold, that of ``sampled_threshold`` is taken.
    """
    if threshold is None:
        threshold = sampled_threshold(voxels, meta, window, value).first()["threshold"]
    rows = grid.assign_tiles(grid.centred_window(voxels, meta, window), meta)
    return rows.groupBy("tile_id").agg(F.max(value).alias("vmax")).withColumn("occupied", F.col("vmax") > threshold)


def occupancy_summary(occupied: DataFrame, n_tiles: int, threshold: float) -> DataFrame:
    """One row: threshold, n_tiles, n_occupied, empty_fraction (0 without tiles)."""
    n = F.count(F.when(F.col("occupied"), 1))
    empty = F.lit(0.0) if not n_tiles else 1 - n / F.lit(n_tiles)
    return occupied.agg(F.lit(float(threshold)).alias("threshold"), F.lit(n_tiles).cast("bigint").alias("n_tiles"), n.alias("n_occupied"), empty.cast("double").alias("empty_fraction"))


def histogram(voxels: DataFrame, value: str = "value", bins: int | None = None, count: str | None = None) -> DataFrame:
    """v, n of each different value, or with ``bins`` of so many equal bins (v is the middle).

    Nulls and values that are not finite are left out. A row stands for as many
    voxels as its column ``count`` says, else for one. Counted per task first.
    """
    rows = voxels.select(F.col(value).alias("v"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("n")).filter(F.col("v").isNotNull())
    if isinstance(voxels.schema[value].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        rows = rows.select(F.col("v").cast("double").alias("v"), "n").filter((F.col("v") > float("-inf")) & (F.col("v") < float("inf")))
    if bins is None:
        return rows.groupBy("v").agg(F.sum("n").alias("n"))
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None or lo == hi:
        return rows.groupBy("v").agg(F.sum("n").alias("n"))
    step = (float(hi) - float(lo)) / bins
    place = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(step)), F.lit(bins - 1))
    return rows.groupBy(place.alias("_b")).agg(F.sum("n").alias("n")).select((F.lit(float(lo)) + (F.col("_b") + 0.5) * step).alias("v"), "n")


def otsu(bins: DataFrame) -> DataFrame:
    """One row ``threshold``: the value with the greatest variance between the classes at or below and above it.

    ``bins`` is a histogram (v, n) of any length. Its running sums have two
    levels: ranges of values in parallel, one row per range in one task. Fewer
    than two values give 0; of equal variances the least value wins.
    """
    rows = bins.select(F.col("v").cast("double").alias("v"), "n").repartitionByRange("v")
    rows = materialize(rows.withColumn("_p", F.spark_partition_id()), "histogram")
    before, all_ = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    mass = F.col("v") * F.col("n")
    base = rows.groupBy("_p").agg(F.sum("n").cast("double").alias("w"), F.sum(mass).cast("double").alias("s")).select(
        "_p", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_base"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s_base"), F.sum("w").over(all_).alias("w"), F.sum("s").over(all_).alias("s")
    )
    up = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(small(materialize(base, "histogram-ranges")), "_p").select(
        "v", (F.col("w_base") + F.sum("n").over(up)).alias("w0"), (F.col("s_base") + F.sum(mass).over(up)).alias("s0"), "w", "s"
    ).filter("w0 < w")
    var = F.expr("w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2)")
    best = run.select("v", var.alias("var")).agg(F.max_by("v", F.struct("var", -F.col("v"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(0.0)).alias("threshold"))


def auto_threshold(voxels: DataFrame, meta: ImageMeta, value: str = "value", widest: int = 64, background: bool = True) -> DataFrame:
    """Otsu's threshold of three windows along the diagonal of the image.

    Absent voxels of a window count as zeros, so that the threshold parts
    objects from background; without ``background`` only the rows count, and it
    parts dim objects from bright ones.
    """
    per_axis = [sampling_windows(s, widest) for s in meta.shape]
    kind, parts = voxels.schema[value].dataType, []
    for i in range(3):
        lo, hi = zip(*(w[i] for w in per_axis))
        rows = grid.region(voxels, meta, lo, hi)
        parts.append(rows.select(value, F.lit(1).cast("bigint").alias("_n")))
        if background:
            absent = F.lit(prod(y - x for x, y in zip(lo, hi))).cast("bigint") - F.count("*")
            parts.append(rows.agg(absent.alias("_n")).filter("_n > 0").select(F.lit(0).cast(kind).alias(value), "_n"))
    return otsu(histogram(reduce(DataFrame.unionByName, parts), value, count="_n"))


def occupied_tiles(tiles: DataFrame, occupancy: DataFrame) -> DataFrame:
    return tiles.join(occupancy.filter("occupied").select("tile_id"), "tile_id", "left_semi")


def empty_tiles(tiles: DataFrame, occupancy: DataFrame) -> DataFrame:
    return tiles.join(occupancy.filter("occupied").select("tile_id"), "tile_id", "left_anti")
