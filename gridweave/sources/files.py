"""Sources: stored datasets, file sequences, metadata documents, and formats without a reader here."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL_AXES = "tczyx"


def read_voxels(spark: SparkSession, path: str, level: int = 0, channel: int | None = None) -> DataFrame:
    """Voxels of one pyramid level and channel of a stored dataset; both are partition columns and prune files.

    A level that is not there is an error that names those that are.
    """
    from ..runtime import exists

    if not exists(spark, f"{path}/voxels/level={level}"):
        raise ValueError(f"level {level} is not in {path}; it has {multiscale_levels(spark, path)}")
    rows = spark.read.parquet(f"{path}/voxels").filter(F.col("level") == level).drop("level")
    return select_channel(rows, channel)


def select_channel(voxels: DataFrame, channel: int | None) -> DataFrame:
    """One channel without its column; None keeps all. An image without channels has channel 0 only."""
    if channel is None:
        return voxels
    if "c" not in voxels.columns:
        if channel > 0:
            raise ValueError(f"the image has no channel axis; channel {channel} does not exist")
        return voxels
    return voxels.filter(F.col("c") == channel).drop("c")


def leading_index(axes: Sequence[str], channel: int | None = 0) -> dict[str, int]:
    """The point of each axis before the spatial ones: the first time, the chosen channel, 0 elsewhere."""
    return {a: (channel or 0) if a == "c" else 0 for a in axes if a not in "zyx"}


def select_leading(voxels: DataFrame, channel: int | None = 0) -> DataFrame:
    """The spatial voxels at ``leading_index``; plain comparisons that reach the scan."""
    point = leading_index([c for c in voxels.columns if c in CANONICAL_AXES], channel)
    for a, v in point.items():
        voxels = voxels.filter(F.col(a) == v)
    return voxels.drop(*point)


def channel_pair(voxels: DataFrame, axes: Sequence[str], first: int, second: int, value: str = "value") -> DataFrame:
    """Two channels side by side: the axes, v1, v2 (0 where a channel has no voxel)."""
    if first == second:
        raise ValueError("the two channels must differ")
    pick = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, F.col(value))), F.lit(0))
    return voxels.filter(F.col("c").isin(first, second)).groupBy(*axes).agg(pick(first).alias("v1"), pick(second).alias("v2"))


def sequence_axes(names: DataFrame, pattern: str, name: str = "name", keep: Sequence[str] = ()) -> DataFrame:
    """Axis columns from file names, by the named groups of ``pattern``; names that do not match are left out.

    Axes come in the order t c z y x; an axis other than z, y and x with a
    single value is dropped. The columns of ``keep`` stay; they are not read to
    find the values of the axes.
    """
    groups = re.compile(pattern).groupindex
    if not groups or set(groups) - set(CANONICAL_AXES):
        raise ValueError("the pattern needs named groups, each one of t, c, z, y, x")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    axes = [a for a in CANONICAL_AXES if a in groups]
    rows = names.filter(F.col(name).rlike(java)).select(name, *keep, *(F.regexp_extract(name, java, groups[a]).cast("int").alias(a) for a in axes))
    loose = [a for a in axes if a in "tc"]
    if loose:
        n = rows.agg(*(F.countDistinct(a).alias(a) for a in loose)).first()
        rows = rows.drop(*(a for a in loose if n[a] <= 1))
    return rows


def read_file_sequence(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files of a glob as rows (path, axes, content); one file is one chunk."""
    if pattern is None and any(c in path for c in "*?["):
        raise ValueError("a glob needs sequence_pattern, a pattern with a named group per axis")
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return sequence_axes(rows, pattern, "path", ["content"]) if pattern else rows


def ngff_attr(attributes: Column, key: str) -> Column:
    """A key of a metadata document, at top level or under ``ome``."""
    return F.coalesce(F.get_json_object(attributes, f"$.{key}"), F.get_json_object(attributes, f"$.ome.{key}"))


def ngff_pixel_size(documents: DataFrame, attributes: str = "attrs", keep: Sequence[str] = ()) -> DataFrame:
    """Scale of level 0 per axis: ``keep`` columns, axis, scale, unit, calibrated."""
    axis = "array<struct<name:string,type:string,unit:string>>"
    level = "array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>>>>>"
    doc = F.from_json(ngff_attr(F.col(attributes), "multiscales"), f"array<struct<axes:{axis},datasets:{level}>>")
    rows = documents.select(*keep, doc.alias("_m")).select(*keep, F.get("_m", F.lit(0)).alias("_m"))
    scale = F.get(F.filter(F.get("_m.datasets", F.lit(0))["coordinateTransformations"], lambda t: t["type"] == "scale"), F.lit(0))["scale"]
    rows = rows.select(*keep, F.explode(F.arrays_zip(F.col("_m.axes").alias("axes"), scale.alias("scale"))).alias("_a"))
    return rows.select(*keep, F.col("_a.axes.name").alias("axis"), F.col("_a.scale").alias("scale"), F.col("_a.axes.unit").alias("unit")).filter(
        F.col("axis").isin("z", "y", "x") & F.col("scale").isNotNull()
    ).withColumn("calibrated", F.lit(True))


def multiscale_levels(spark: SparkSession, path: str) -> list[int]:
    """The levels of a stored dataset, from its partitions alone."""
    return sorted(r["level"] for r in spark.read.parquet(f"{path}/voxels").select("level").distinct().collect())


def label_names(spark: SparkSession, path: str) -> DataFrame:
    """The registered label images: name, n_objects, sequential."""
    return spark.read.schema("n_objects bigint, sequential boolean, name string").parquet(f"{path}/catalog").select("name", "n_objects", "sequential")


def read_labels(spark: SparkSession, path: str, name: str, level: int = 0) -> DataFrame:
    return spark.read.parquet(f"{path}/labels").filter((F.col("name") == name) & (F.col("level") == level)).drop("name", "level")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tile manifests written as JSON."""
    schema = "tile_shape array<int>, overlap array<int>, n_tiles int, occupied array<int>, tiles_per_job int, batches array<array<int>>, target_path string, target_component string, in_place boolean"
    return spark.read.schema(schema).json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, tile_id, n of the batches that ended; none without the folder."""
    from ..runtime import exists

    ddl = "tile_id bigint, n bigint, batch_id bigint"
    if not exists(spark, path):
        return spark.createDataFrame([], ddl).select("batch_id", "tile_id", "n")
    return spark.read.schema(ddl).json(path).select("batch_id", "tile_id", "n")


def union_counts(markers: DataFrame) -> DataFrame:
    """tile_id, n of all batch markers (batch, counts map of tile to n); a redelivered batch counts once."""
    rows = markers.select("batch", F.explode("counts").alias("tile_id", "n"))
    return rows.groupBy(F.col("tile_id").cast("bigint").alias("tile_id")).agg(F.max("n").cast("bigint").alias("n"))


def _missing(kind: str, library: str):
    def read(*_, **__):
        raise NotImplementedError(f"{kind} files need the library {library}, which is not installed; convert them to Parquet voxels or an image sequence first")

    return read


read_imaris = _missing("Imaris", "h5py")
read_microscope = _missing("CZI, LIF and ND2", "bioio")


def open_source(spark: SparkSession, source, pattern: str | None = None, level: int = 0, channel: int | None = None) -> DataFrame:
    """Voxels from a DataFrame, a NumPy array, a dataset folder, an OME-Zarr store or a glob of TIFF planes; files of another glob as they are."""
    import numpy as np

    if isinstance(source, DataFrame):
        return source
    if isinstance(source, np.ndarray):
        return from_array(spark, source)
    text = str(source)
    if text.endswith(".ims"):
        return read_imaris(text)
    if text.endswith((".czi", ".lif", ".nd2")):
        return read_microscope(text)
    if pattern is not None or any(c in text for c in "*?["):
        if pattern is not None and text.lower().endswith((".tif", ".tiff")):
            from .tiff import read_tiff_sequence

            return read_tiff_sequence(spark, text, pattern)
        return read_file_sequence(spark, text, pattern)
    if text.rstrip("/").endswith(".zarr"):
        from .zarr import read_zarr

        return read_zarr(spark, text, level, channel)
    return select_channel(read_voxels(spark, text, level), channel)


def from_array(spark: SparkSession, a, axes: str | None = None) -> DataFrame:
    """Voxels other than 0 of a small driver-side array; axes are taken from the right of ``tczyx``."""
    import numpy as np
    import pandas as pd

    if axes is None:
        if a.ndim > len(CANONICAL_AXES):
            raise ValueError("name the axes of an array of more than five dimensions")
        axes = CANONICAL_AXES[-a.ndim :]
    place = np.nonzero(a)
    whole = np.issubdtype(a.dtype, np.integer) or a.dtype == bool
    ddl = ", ".join(f"{x} int" for x in axes) + (", value bigint" if whole else ", value double")
    data = {x: p.astype("int32") for x, p in zip(axes, place)} | {"value": a[place].astype("int64" if whole else "float64")}
    return spark.createDataFrame(pd.DataFrame(data), ddl)
