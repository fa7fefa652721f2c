"""Sinks: pyramids of images and labels, the label catalog, occupancy maps, manifests and relation sheets."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import ImageMeta
from ..operators import occupancy, pyramid
from ..operators.grid import assign_tiles
from ..runtime import exists, materialize, read_text, write_text
from .files import label_names


def write_image(
    voxels: DataFrame,
    path: str,
    axes: Sequence[str],
    n_levels: int = 5,
    downscale: int = 2,
    overwrite: bool = False,
    files_per_level: int | None = None,
    meta: ImageMeta | None = None,
    name: str | None = None,
) -> str:
    """Write an image with its pyramid as ``voxels/level=...`` (and ``c=...`` for an image of channels).

    With ``meta`` the multiscales document, with the pixel size, is written as
    ``image.json``.
    """
    parts = ["level", *(["c"] if "c" in axes else [])]
    rows = pyramid.pyramid(voxels, axes, n_levels, downscale)
    if files_per_level:
        rows = rows.repartition(files_per_level * n_levels, *parts, *(F.floor(F.col(a) / 128) for a in axes if a in "zyx"))
    rows = rows.sortWithinPartitions(*parts, *(a for a in axes if a != "c"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*parts).option("compression", "zstd").parquet(f"{path}/voxels")
    if meta is not None:
        write_metadata(voxels.sparkSession, path, meta, n_levels, downscale, name)
    return path


def write_metadata(spark: SparkSession, path: str, meta: ImageMeta, n_levels: int = 5, downscale: int = 2, name: str | None = None, file: str = "image.json") -> None:
    """The multiscales document of a stored image; other keys of the file stay as they are."""
    from ..operators import dense
    from .zarr import multiscales

    target = f"{path}/{file}"
    old = json.loads(read_text(spark, target)) if exists(spark, target) else {}
    metas = [dense.level_meta(meta, i, downscale) for i in range(n_levels)]
    write_text(spark, target, json.dumps(old | {"multiscales": multiscales(metas, name, meta.scale, "0.4")}, indent=1))


def read_scale(spark: SparkSession, path: str, file: str = "image.json") -> tuple[dict[str, float], str | None]:
    """Pixel size per calibrated axis and unit of a stored image; empty without a document."""
    if not exists(spark, f"{path}/{file}"):
        return {}, None
    image = json.loads(read_text(spark, f"{path}/{file}"))["multiscales"][0]
    scale = image["datasets"][0]["coordinateTransformations"][0]["scale"]
    held = {a["name"]: s for a, s in zip(image["axes"], scale) if a.get("unit")}
    return held, next((a["unit"] for a in image["axes"] if a.get("unit")), None)


def add_pyramid(spark: SparkSession, path: str, axes: Sequence[str], n_levels: int = 5, downscale: int = 2) -> None:
    """Add the levels above 0 to a stored image; existing ones are replaced one partition at a time."""
    base = spark.read.parquet(f"{path}/voxels").filter("level = 0").drop("level")
    rows = pyramid.pyramid(base, axes, n_levels, downscale).filter("level > 0")
    parts = ["level", *(["c"] if "c" in axes else [])]
    materialize(rows, "pyramid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/voxels")


def write_labels(
    labels: DataFrame, path: str, name: str, axes: Sequence[str], n_levels: int = 5, downscale: int = 2, n_objects: int | None = None, sequential: bool = False, overwrite: bool = False, meta: ImageMeta | None = None
) -> str:
    """Write a label image with its pyramid under its name and register it; other names stay as they are.

    With ``meta``, its document ``labels-<name>.json`` is written; a pixel size
    that ``meta`` does not give is that of the image.
    """
    spark = labels.sparkSession
    target = f"{path}/labels"
    if not overwrite and exists(spark, f"{target}/name={name}"):
        raise FileExistsError(f"label image {name} exists")
    rows = pyramid.pyramid(labels, axes, n_levels, downscale).withColumn("name", F.lit(name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "level").option("compression", "zstd").parquet(target)
    if meta is not None:
        scale, unit = read_scale(spark, path)
        meta = replace(meta, scale={a: v for a, v in scale.items() if a in meta.axes} | meta.scale, unit=unit or meta.unit)
        write_metadata(spark, path, meta, n_levels, downscale, name, f"labels-{name}.json")
    register_labels(spark, path, name, n_objects, sequential)
    return f"{target}/name={name}"


def register_labels(spark: SparkSession, path: str, name: str, n_objects: int | None = None, sequential: bool = False) -> None:
    """Enter a label image in the catalog; doing it again replaces its entry.

    Each name has a folder of its own, so sinks of different names that end at
    the same moment do not lose each other's entries.
    """
    row = spark.createDataFrame([(n_objects, sequential)], "n_objects bigint, sequential boolean")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog/name={name}")


def build_occupancy(voxels: DataFrame, path: str, axes: Sequence[str], block: Sequence[int], level: int = 0, overwrite: bool = False) -> str:
    """Write the map of brick maxima of all channels; an existing one of the same bricks is used again."""
    spark = voxels.sparkSession
    target, note = f"{path}/occupancy/level={level}", f"{path}/occupancy-{level}.json"
    said = json.dumps({"axes": list(axes), "block": list(block)})
    if not overwrite and exists(spark, note) and read_text(spark, note) == said:
        return target
    keep = ["c"] if "c" in voxels.columns else []
    occupancy.block_max(voxels, axes, block, keep=keep).write.mode("overwrite").parquet(target)
    write_text(spark, note, said)
    return target


def write_manifest(spark: SparkSession, path: str, meta: ImageMeta, occupied: Sequence[int], per_job: int, target_path: str, target_component: str = "staged", in_place: bool = False) -> None:
    """The tile plan of a run as one JSON row."""
    from ..planner import batches

    row = {
        "tile_shape": list(meta.tile), "overlap": list(meta.halo), "n_tiles": meta.n_tiles, "occupied": list(occupied), "tiles_per_job": per_job,
        "batches": batches(occupied, per_job), "target_path": target_path, "target_component": target_component, "in_place": in_place,
    }
    write_text(spark, path, json.dumps(row))


def create_stage(spark: SparkSession, path: str, meta: ImageMeta) -> None:
    """An empty stage: the folder of the staged labels and the shape of its tiles. A stage that is there already is an error."""
    if exists(spark, f"{path}/stage.json"):
        raise FileExistsError(f"{path} holds a stage")
    ddl = ", ".join(["tile_id bigint", *(f"{a} int" for a in meta.axes), "local bigint"])
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(f"{path}/staged")
    write_text(spark, f"{path}/stage.json", json.dumps({"axes": meta.axes, "shape": meta.shape, "tile_shape": meta.tile}))


def write_counts(staged: DataFrame, plan: DataFrame, path: str) -> None:
    """The markers of batches that ended: the label counts of their tiles as JSON, one folder per batch, put in place together."""
    n = staged.groupBy("tile_id").agg(F.max("local").alias("n"))
    rows = plan.select("tile_id", "batch_id").join(n, "tile_id", "left").select("batch_id", "tile_id", F.coalesce("n", F.lit(0)).alias("n"))
    rows.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").json(path)


def write_staged(staged: DataFrame, path: str, meta: ImageMeta) -> None:
    """Staged labels in tile order, each tile within one file."""
    rows = staged if "tile_id" in staged.columns else assign_tiles(staged, meta)
    rows.repartition("tile_id").sortWithinPartitions("tile_id", *meta.axes).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_relations(per_a: DataFrame, per_b: DataFrame, path: str) -> None:
    """Both sheets of a relation as CSV with a header."""
    for sheet, rows in (("per_a", per_a), ("per_b", per_b)):
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{sheet}")


def layers(spark: SparkSession, path: str) -> DataFrame:
    """What a viewer would show: one row per image level and label level (kind, name, level, n_objects)."""
    image = spark.read.parquet(f"{path}/voxels").select("level").distinct().select(F.lit("image").alias("kind"), F.lit("image").alias("name"), "level", F.lit(None).cast("bigint").alias("n_objects"))
    if not exists(spark, f"{path}/catalog"):
        return image
    names = spark.read.parquet(f"{path}/labels").select("name", "level").distinct()
    known = label_names(spark, path).select("name", "n_objects")
    return image.unionByName(names.join(known, "name").select(F.lit("labels").alias("kind"), "name", "level", "n_objects"))
