"""Running a user function on every tile, once, and staging its labels."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import ImageMeta
from . import grid, kernels

#: A dense haloed tile may have so many bytes; larger ones raise before the function runs.
MAX_TILE_BYTES = 1 << 30


def _box(meta: ImageMeta, tile: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Core box and haloed box of a tile, clipped to the image."""
    index = [tile // k % g for k, g in zip(meta.tile_steps, meta.grid)]
    lo = [i * t for i, t in zip(index, meta.tile)]
    hi = [min(x + t, s) for x, t, s in zip(lo, meta.tile, meta.shape)]
    return lo, hi, [max(0, x - h) for x, h in zip(lo, meta.halo)], [min(s, x + h) for x, h, s in zip(hi, meta.halo, meta.shape)]


def stage_tiles(
    voxels: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    meta: ImageMeta,
    value: str = "value",
    empty_threshold: float | None = None,
    empty_scope: str = "haloed",
    dtype: str = "float64",
    tiles: DataFrame | None = None,
    channels: int | None = None,
    channel_axis: int = 0,
) -> DataFrame:
    """Labels of every tile: tile_id, the axes, local (1..n within the tile).

    ``fn`` gets the dense haloed tile (absent voxels are 0) and returns labels
    of the same shape; the halo is cut off and labels are renumbered by value,
    background staying 0. Tiles without voxels do not run. With
    ``empty_threshold``, tiles whose greatest value (of the haloed tile, or of
    its core) does not exceed it do not run either. Rows with a null coordinate
    or value, or outside the image, hold no voxel. With ``tiles`` (tile_id) only
    those tiles run. A voxel that comes twice takes its greatest value.

    With ``channels``, the voxels have a column ``c`` from 0 to that number,
    and ``fn`` gets all channels of a tile along ``channel_axis``; the labels
    have the spatial axes alone.
    """
    axes = list(meta.axes)
    voxels_of = int(np.prod([min(t + 2 * h, s) for t, h, s in zip(meta.tile, meta.halo, meta.shape)], dtype=float))
    size = np.dtype(dtype).itemsize * voxels_of * (channels or 1)
    if size > MAX_TILE_BYTES:
        raise ValueError(f"a haloed tile has {size} bytes; the limit is {MAX_TILE_BYTES}")
    if empty_scope not in ("core", "haloed"):
        raise ValueError("empty_scope is 'core' or 'haloed'")
    lead = ["c"] if channels else []
    rows = voxels.select(*lead, *axes, F.col(value).cast("double").alias("value")).dropna()
    for a, s in zip([*lead, *axes], [*([channels] if channels else []), *meta.shape]):
        rows = rows.filter((F.col(a) >= 0) & (F.col(a) < s))
    rows = grid.assign_halo(rows, meta)
    if tiles is not None:
        rows = rows.join(tiles.select("tile_id"), "tile_id", "left_semi")
    none = pa.table({"tile_id": pa.array([], pa.int64())} | {a: pa.array([], pa.int32()) for a in axes} | {"local": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile_id")[0].as_py()
        lo, hi, low, high = _box(meta, tile)
        shape = [b - a for a, b in zip(low, high)]
        core = tuple(slice(a - x, b - x) for a, b, x in zip(lo, hi, low))
        dense = np.full([channels or 1, *shape], -np.inf)
        c = table.column("c").to_numpy() if channels else 0
        at = tuple(table.column(a).to_numpy() - x for a, x in zip(axes, low))
        np.maximum.at(dense, (c, *at), table.column("value").to_numpy())
        dense[np.isneginf(dense)] = 0
        if empty_threshold is not None and dense[(slice(None), *core) if empty_scope == "core" else ...].max() <= empty_threshold:
            return none
        dense = dense.astype(dtype)
        labels = np.asarray(fn(np.moveaxis(dense, 0, channel_axis) if channels else dense[0]))
        if list(labels.shape) != shape:
            name = getattr(fn, "__name__", repr(fn))
            raise ValueError(f"{name} returned shape {labels.shape} for tile {tile} of shape {tuple(shape)}; it must give one label per input voxel")
        local = kernels.dense_rank(labels[core].astype(np.int64))
        place = np.nonzero(local)
        cols = [pa.array(np.full(len(place[0]), tile)), *(pa.array((p + x).astype(np.int32)) for p, x in zip(place, lo)), pa.array(local[place])]
        return pa.Table.from_arrays(cols, names=["tile_id", *axes, "local"])

    ddl = f"tile_id bigint, {', '.join(f'{a} int' for a in axes)}, local bigint"
    return rows.select("tile_id", *lead, *axes, "value").groupBy("tile_id").applyInArrow(run, ddl)


def stage_tile(voxels: DataFrame, fn: Callable[[np.ndarray], np.ndarray], meta: ImageMeta, tile: int, path: str, **stage) -> int:
    """Stage one tile into ``path/tile_id=...`` and return its number of labels; doing it again replaces it.

    Only the haloed box of the tile is read.
    """
    if not 0 <= tile < meta.n_tiles:
        raise ValueError(f"tile {tile} is not one of {meta.n_tiles}")
    _, _, low, high = _box(meta, tile)
    one = voxels.sparkSession.range(tile, tile + 1).withColumnRenamed("id", "tile_id")
    rows = stage_tiles(grid.region(voxels, meta, low, high), fn, meta, tiles=one, **stage)
    target = f"{path}/tile_id={tile}"
    rows.drop("tile_id").write.mode("overwrite").parquet(target)
    return voxels.sparkSession.read.schema(rows.drop("tile_id").schema).parquet(target).agg(F.coalesce(F.max("local"), F.lit(0)).alias("n")).first()["n"]


def dense_relabel(labels: DataFrame, meta: ImageMeta, label: str = "label") -> DataFrame:
    """Per tile, labels renumbered 1..n by value; rows of background or null are left out."""
    from pyspark.sql import Window

    rows = grid.assign_tiles(labels.filter(F.col(label) > 0), meta)
    return rows.withColumn("local", F.dense_rank().over(Window.partitionBy("tile_id").orderBy(label)).cast("bigint"))


# --- named tile functions ------------------------------------------------------

_METHODS: dict[str, Callable] = {}


def register(name: str, factory: Callable) -> None:
    """Make a tile function known by name; ``factory(**kwargs)`` returns it."""
    _METHODS[name] = factory


def _threshold_factory(threshold: float | None = None, connectivity: str = "full") -> Callable:
    from functools import partial

    return partial(kernels.threshold_label, threshold=threshold, connectivity=connectivity)


def _custom_factory(module: str, function: str = "segment", kwargs: dict | None = None) -> Callable:
    import importlib
    from functools import partial

    fn = getattr(importlib.import_module(module), function)
    return partial(fn, **kwargs) if kwargs else fn


register("threshold", _threshold_factory)
register("dog", kernels.dog_label_fn)
register("custom", _custom_factory)


def validate_config(config: dict) -> list[str]:
    """All problems of a segmentation config at once: unknown method, unknown settings, bad dilation."""
    problems = []
    method = config.get("method")
    if method not in _METHODS:
        problems.append(f"unknown method {method!r}; known: {', '.join(sorted(_METHODS))}")
    else:
        known = inspect.signature(_METHODS[method]).parameters
        problems += [f"{method} has no setting {k!r}" for k in config.get("settings", {}) if k not in known]
        if method == "custom":
            problems += _custom_problems(config.get("settings", {}))
    if not isinstance(config.get("dilate", 0), int) or config.get("dilate", 0) < 0:
        problems.append("dilate must be a whole number, 0 or more")
    problems += [f"unknown key {k!r}" for k in config if k not in ("method", "settings", "dilate")]
    return problems


def _custom_problems(settings: dict) -> list[str]:
    """What keeps a function of one's own from running: its module, its name, its keywords."""
    import importlib

    module, name, kwargs = settings.get("module"), settings.get("function", "segment"), settings.get("kwargs") or {}
    if not module:
        return ["custom needs a module"]
    try:
        fn = getattr(importlib.import_module(module), name, None)
    except ImportError as e:
        return [f"custom module {module!r} can not be imported: {e}"]
    if not callable(fn):
        return [f"custom module {module!r} has no function {name!r}"]
    if not isinstance(kwargs, dict):
        return ["custom kwargs must be a mapping"]
    known = inspect.signature(fn).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in known):
        return []
    free = {p.name for p in list(known)[1:] if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    return [f"{module}.{name} has no keyword {k!r}" for k in kwargs if k not in free]


def build_fn(config: dict, voxel_size: dict[str, float] | None = None) -> Callable:
    """The tile function of a config; one that asks for ``voxel_size`` gets the image's calibration."""
    if problems := validate_config(config):
        raise ValueError("; ".join(problems))
    fn = _METHODS[config["method"]](**config.get("settings", {}))
    target = getattr(fn, "func", fn)
    given = getattr(fn, "keywords", None) or {}
    if voxel_size is not None and "voxel_size" in inspect.signature(target).parameters and "voxel_size" not in given:
        from functools import partial

        fn = partial(fn, voxel_size=voxel_size)
    return kernels.dilate_labels(fn, config.get("dilate", 0))


def batches_of(tiles: DataFrame, per_job: int) -> DataFrame:
    """tile_id, batch_id of consecutive tiles, ``per_job`` each, numbered by range partitions as ``merge.sequential`` does."""
    from .merge import sequential

    return sequential(tiles, "tile_id").select("tile_id", F.expr(f"(seq - 1) div {int(per_job)}").cast("bigint").alias("batch_id"))
