"""Whole runs: prepare a tile plan, segment its batches, merge, and relate several segmentations."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planner
from .meta import ImageMeta
from .operators import dense, grid, merge, occupancy, relations, staged
from .runtime import exists, materialize, remove, small, work_folder
from .sources import files, sinks, zarr


def prepare(voxels: DataFrame, meta: ImageMeta, per_job: int = 8, skip_empty: bool = True, threshold: float | None = None) -> DataFrame:
    """The plan of a run: tile_id, batch_id of the tiles that will run.

    The halo must be narrower than the tile. Without a threshold, Otsu's value
    of three sample windows decides which tiles are empty.
    """
    if planner.halo_amplification(meta.tile, meta.halo, meta.shape) > 3:
        warnings.warn("the halo makes each tile more than three times as large; wider tiles are advisable", stacklevel=2)
    tiles = grid.tile_grid(voxels.sparkSession, meta).select("tile_id")
    if skip_empty:
        if threshold is None:
            threshold = occupancy.auto_threshold(voxels, meta).first()["threshold"]
        block = planner.block_for_tile(meta.tile)
        occ = occupancy.tile_occupancy(occupancy.block_max(voxels, meta.axes, block), meta, block, threshold)
        tiles = occupancy.occupied_tiles(tiles, occ)
    return staged.batches_of(tiles, per_job)


def segment(voxels: DataFrame, fn: Callable, meta: ImageMeta, plan: DataFrame, **stage) -> DataFrame:
    """Staged labels of the planned tiles; the others are cut off before the function."""
    return staged.stage_tiles(voxels, fn, meta, tiles=plan, **stage)


def segment_batches(voxels: DataFrame, fn: Callable, meta: ImageMeta, plan: DataFrame, base: str, wave: int = 64, **stage) -> int:
    """Stage the batches of a plan that have no marker in ``base`` yet; returns how many ran.

    ``wave`` batches are one Spark job, so the driver's loop is short and a
    break-off costs one wave. Labels and counts are written one folder per
    batch, through dynamic partition overwrite: doing a batch again replaces it.
    """
    spark = voxels.sparkSession
    counts, rows = f"{base}/counts", f"{base}/staged"
    known = files.read_counts(spark, counts).select("batch_id").distinct()
    todo = sorted(r["batch_id"] for r in plan.select("batch_id").distinct().join(known, "batch_id", "left_anti").collect())
    for i in range(0, len(todo), wave):
        part = materialize(plan.filter(F.col("batch_id").isin(todo[i : i + wave])), "wave")
        found = materialize(segment(voxels, fn, meta, part, **stage).join(small(part), "tile_id"), "wave-staged")
        found.hint("rebalance", "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch_id").parquet(rows)
        sinks.write_counts(found, part, counts)
    return len(todo)


def merge_batches(spark: SparkSession, meta: ImageMeta, base: str, sequential_ids: bool = True) -> DataFrame:
    """The merged labels of all batches in ``base``."""
    ddl = ", ".join(["tile_id bigint", *(f"{a} int" for a in meta.axes), "local bigint", "batch_id bigint"])
    if not exists(spark, f"{base}/staged"):
        return spark.createDataFrame([], ", ".join([*(f"{a} int" for a in meta.axes), "label bigint"]))
    rows = spark.read.schema(ddl).parquet(f"{base}/staged").drop("batch_id")
    return merge.merge_labels(rows, meta, files.read_counts(spark, f"{base}/counts").select("tile_id", "n"), sequential_ids)


def process(
    voxels: DataFrame,
    fn: Callable,
    meta: ImageMeta,
    write_to: str | None = None,
    name: str = "labels",
    sequential_ids: bool = False,
    pyramid_levels: int = 5,
    downscale: int = 2,
    skip_empty: bool = False,
    threshold: float | None = None,
    per_job: int = 8,
    stage_dir: str | None = None,
    keep_stage: bool = False,
    **stage,
) -> DataFrame:
    """Segment an image tile by tile, merge the labels and, with ``write_to``, publish them there; returns the labels.

    ``write_to`` is a stored dataset, or an OME-Zarr store (``....zarr``) that
    holds the image. The plan, the staged batches and their markers lie in
    ``stage_dir`` (by default beside the labels, or among the intermediate
    tables). A run that broke off goes on with its plan and the batches that
    have no marker; they are removed at the end unless ``keep_stage``. With
    ``skip_empty``, tiles whose greatest value does not exceed the threshold (by
    default Otsu's) are left out of the plan.
    """
    spark = voxels.sparkSession
    base = (stage_dir or (f"{write_to.removesuffix('.zarr')}-stage" if write_to else work_folder(spark, "stage"))).rstrip("/") + f"/{name}"
    if not exists(spark, f"{base}/plan/_SUCCESS"):
        prepare(voxels, meta, per_job, skip_empty, threshold).write.mode("overwrite").parquet(f"{base}/plan")
    plan = spark.read.schema("tile_id bigint, batch_id bigint").parquet(f"{base}/plan")
    segment_batches(voxels, fn, meta, plan, base, **stage)
    labels = materialize(merge_batches(spark, meta, base, sequential_ids), "labels")
    if write_to:
        n = merge.object_count(labels).first()["n_objects"]
        if write_to.endswith(".zarr"):
            plain = replace(meta, halo=(0,) * len(meta.axes))
            zarr.write_zarr_labels(dense.to_chunks(labels, plain, "int64", "label"), write_to, plain, name, "int64", pyramid_levels, downscale, overwrite=True, n_objects=n)
        else:
            sinks.write_labels(labels, write_to, name, meta.axes, pyramid_levels, downscale, n_objects=n, sequential=sequential_ids, overwrite=True, meta=meta)
    if not keep_stage:
        remove(spark, base)
    return labels


def run(voxels: DataFrame, config: dict, meta: ImageMeta, path: str, name: str, sequential_ids: bool = True, n_levels: int = 5, **options) -> DataFrame:
    """``process`` with the function of a config, published in ``path`` under ``name``; returns the labels."""
    fn = staged.build_fn(config, meta.scale or None)
    return process(voxels, fn, meta, path, name, sequential_ids, n_levels, **options)


def convert(
    spark: SparkSession,
    source,
    path: str,
    pattern: str | None = None,
    chunks: Sequence[int] | None = None,
    dtype: str = "uint16",
    scale: dict[str, float] | None = None,
    unit: str = "micrometer",
    n_levels: int = 5,
    downscale: int = 2,
    version: int = 2,
    codec: str | None = "zstd",
    shard: bool | Sequence[int] = False,
    name: str | None = None,
    overwrite: bool = False,
):
    """Any source as an OME-Zarr store with its pyramid and metadata.

    A store keeps its pixel size; for a file sequence of TIFF planes it is that
    of the first file that has one; ``scale`` goes before both.
    """
    from .sources import tiff

    known: dict[str, float] = {}
    text = source if isinstance(source, str) else ""
    if text.rstrip("/").endswith(".zarr"):
        known = zarr.image_meta(spark, text).scale
    elif text.lower().endswith((".tif", ".tiff")) and pattern:
        sizes = tiff.sequence_calibration(spark, text).groupBy("axis").agg(F.min_by("size_nm", "path").alias("nm")).collect()
        known = {r["axis"]: r["nm"] / 1000 for r in sizes}
    voxels = files.open_source(spark, source, pattern)
    if not isinstance(source, DataFrame):
        voxels = materialize(voxels, "source")
    axes = tuple(a for a in files.CANONICAL_AXES if a in voxels.columns)
    top = voxels.agg(*(F.max(a).alias(a) for a in axes)).first()
    shape = tuple((top[a] if top[a] is not None else 0) + 1 for a in axes)
    tile = tuple(min(c, s) for c, s in zip(chunks, shape)) if chunks else planner.default_chunks(shape, "".join(axes))
    meta = ImageMeta(axes, shape, tile, (0,) * len(axes), {a: v for a, v in (known | (scale or {})).items() if a in axes}, unit)
    return zarr.write_zarr(dense.to_chunks(voxels, meta, dtype), path, meta, dtype, n_levels, downscale, version, codec, shard, name, overwrite)


def occupancy_job(spark: SparkSession, path: str, tile: Sequence[int], level: int = 0, overwrite: bool = False) -> str:
    """The map of brick maxima of a stored image, with bricks that fit its tiles; returns where it lies."""
    voxels = files.read_voxels(spark, path, level)
    axes = [a for a in "zyx" if a in voxels.columns]
    return sinks.build_occupancy(voxels, path, axes, planner.block_for_tile(tile), level, overwrite)


def fetch_model(load: Callable) -> str:
    """Load a model once on the driver, so that its files are there before the tasks want them; returns its type."""
    return type(load()).__name__


def run_many(voxels: DataFrame, configs: dict[str, dict], meta: ImageMeta, path: str, pairs: list[tuple[str, str]], common: dict | None = None) -> dict[tuple[str, str], tuple[DataFrame, DataFrame]]:
    """Several segmentations of one image and the relations between named pairs of them.

    All configs are checked before anything runs. Returns the two sheets of
    each pair: every a with its match, and every b with what matches it.
    """
    merged = {name: {**(common or {}), **c} for name, c in configs.items()}
    problems = [f"{name}: {p}" for name, c in merged.items() for p in staged.validate_config(c)]
    problems += [f"pair {pair}: unknown segmentation {n!r}" for pair in pairs for n in pair if n not in merged]
    if problems:
        raise ValueError("; ".join(problems))
    labels = {name: run(voxels, c, meta, path, name) for name, c in merged.items()}
    out = {}
    for a, b in pairs:
        rel = materialize(relations.label_relations(labels[a], labels[b], meta.axes), "relations")
        sheets = relations.relations_per_a(relations.label_ids(labels[a]), rel), relations.relations_per_b(relations.label_ids(labels[b]), rel)
        sinks.write_relations(*sheets, f"{path}/relations/{a}-{b}")
        out[a, b] = sheets
    return out


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine assumes."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
