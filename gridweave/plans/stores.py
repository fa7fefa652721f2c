"""Queries that write OME-Zarr stores and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..meta import ImageMeta
from ..operators import dense
from ..runtime import work_folder
from ..sources import zarr
from . import rasters
from .rasters import FOREGROUND, SQL_2D, SQL_CYX

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _image(spark, sf, path, **how):
    """The embedding raster as a store with three levels."""
    meta = rasters.meta2d(spark, sf, halo=0)
    meta = ImageMeta(meta.axes, meta.shape, meta.tile, (0, 0), {"y": 0.5, "x": 0.25})
    zarr.write_zarr(dense.to_chunks(rasters.emb2d(spark, sf), meta, "int32"), path, meta, "int32", n_levels=3, name="raster", **how)
    return meta


_LEVELS = f"WITH {SQL_2D} SELECT CAST(i AS INTEGER) AS level, CAST(y // CAST(pow(2, i) AS INTEGER) AS INTEGER) AS y, CAST(x // CAST(pow(2, i) AS INTEGER) AS INTEGER) AS x, CAST(value AS BIGINT) AS value FROM e, unnest(range(3)) AS r(i) WHERE value <> 0 AND y % CAST(pow(2, i) AS INTEGER) = 0 AND x % CAST(pow(2, i) AS INTEGER) = 0"


def _levels(spark, path):
    rows = None
    for i in range(3):
        level = zarr.read_zarr(spark, path, i).select(F.lit(i).alias("level"), "y", "x", "value")
        rows = level if rows is None else rows.unionByName(level)
    return rows


def zarr_round_trip(spark, sf):
    """Written in format 2, read as chunks, written again in format 3 with shards, and read: all levels."""
    base = work_folder(spark, "zarr")
    _image(spark, sf, f"{base}/two.zarr", version=2, codec="gzip")
    chunks, meta, dtype = zarr.read_zarr_chunks(spark, f"{base}/two.zarr")
    zarr.write_zarr(chunks, f"{base}/three.zarr", meta, dtype, n_levels=3, version=3, codec="zstd", shard=(128, 32))
    return _levels(spark, f"{base}/three.zarr")


def zarr_channel_region(spark, sf):
    """One channel and a box of a store of channels; other chunks are not opened."""
    path = f"{work_folder(spark, 'zarr')}/events.zarr"
    rows = rasters.ev_cyx(spark, sf)
    shape = rasters.extent(rows, "cyx")
    meta = ImageMeta(("c", "y", "x"), shape, (1, 32, 128))
    zarr.write_zarr(dense.to_chunks(rows, meta, "uint16"), path, meta, "uint16", n_levels=1, version=3)
    return zarr.read_zarr(spark, path, channel=2, lo=(0, 10, 50), hi=(shape[0], 90, 600))


def zarr_scales(spark, sf):
    """Pixel size of each level, of the image and of labels that inherit it: name, level, axis, scale, unit."""
    path = f"{work_folder(spark, 'zarr')}/image.zarr"
    meta = _image(spark, sf, path, version=2)
    labels = rasters.emb2d(spark, sf).filter(F.col("value") > FOREGROUND)
    plain = ImageMeta(meta.axes, meta.shape, meta.tile)
    zarr.write_zarr_labels(dense.to_chunks(labels, plain, "int64"), path, plain, "cells", n_levels=2)
    out = []
    for name in ["", *zarr.zarr_label_names(spark, path)]:
        store = zarr.open_store(spark, f"{path}/labels/{name}" if name else path)
        for level, scale in enumerate(store.scales):
            out += [(store.name, level, a, s, u) for a, s, u in zip(store.axes, scale, store.units)]
    return spark.createDataFrame(out, "name string, level int, axis string, scale double, unit string")


def zarr_labels(spark, sf):
    """Labels of a store with their pyramid: name, level, y, x, label."""
    path = f"{work_folder(spark, 'zarr')}/image.zarr"
    meta = _image(spark, sf, path, version=3)
    labels = rasters.emb2d(spark, sf).filter(F.col("value") > FOREGROUND)
    zarr.write_zarr_labels(dense.to_chunks(labels, meta, "int64"), path, meta, "cells", n_levels=1)
    zarr.add_pyramid(spark, f"{path}/labels/cells", 3)
    rows = _levels(spark, f"{path}/labels/cells")
    return rows.select(F.lit(zarr.zarr_label_names(spark, path)[0]).alias("name"), "level", "y", "x", F.col("value").alias("label"))


for _f in (zarr_round_trip, zarr_channel_region, zarr_scales, zarr_labels):
    QUERIES[_f.__name__] = _f
SQL["zarr_round_trip"] = _LEVELS
SQL["zarr_channel_region"] = f"WITH {SQL_CYX} SELECT y, x, CAST(value AS BIGINT) AS value FROM v WHERE c = 2 AND y >= 10 AND y < 90 AND x >= 50 AND x < 600"
SQL["zarr_labels"] = _LEVELS.replace("SELECT CAST(i", "SELECT 'cells' AS name, CAST(i").replace("AS value FROM e,", "AS label FROM e,").replace("value <> 0", f"value > {FOREGROUND}")
SQL["zarr_scales"] = (
    "SELECT name, CAST(i AS INTEGER) AS level, axis, CAST(s * pow(2, i) AS DOUBLE) AS scale, 'micrometer' AS unit FROM (VALUES ('raster', 3), ('cells', 2)) n(name, k), (VALUES ('y', 0.5), ('x', 0.25)) a(axis, s), unnest(range(k)) AS r(i)"
)
