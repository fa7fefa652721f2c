"""Tiled array analytics and data-preparation operators on Spark DataFrames."""

from __future__ import annotations

__version__ = "0.1.0"

#: Public names and the modules that hold them; imported when first used, so that workers load little.
_PUBLIC = {
    "ImageMeta": "meta",
    "auto_overlap": "planner",
    "auto_tile_shape": "planner",
    "auto_tile_shape_model": "planner",
    "safe_worker_count": "planner",
    "capped_output_chunks": "planner",
    "block_for_tile": "planner",
    "tile_process": "operators.merge",
    "merge_labels": "operators.merge",
    "touching_pairs": "operators.merge",
    "stage_tiles": "operators.staged",
    "stage_chunks": "operators.dense",
    "build_fn": "operators.staged",
    "dense_relabel": "operators.staged",
    "block_max": "operators.occupancy",
    "tile_occupancy": "operators.occupancy",
    "sampled_occupancy": "operators.occupancy",
    "auto_threshold": "operators.occupancy",
    "label_relations": "operators.relations",
    "region_props": "operators.relations",
    "pyramid": "operators.pyramid",
    "dilate_labels": "operators.kernels",
    "dog_label_fn": "operators.kernels",
    "write_image": "sources.sinks",
    "write_labels": "sources.sinks",
    "register_labels": "sources.sinks",
    "build_occupancy": "sources.sinks",
    "read_voxels": "sources.files",
    "read_labels": "sources.files",
    "open_source": "sources.files",
    "read_zarr": "sources.zarr",
    "read_zarr_chunks": "sources.zarr",
    "write_zarr": "sources.zarr",
    "write_zarr_labels": "sources.zarr",
    "add_pyramid": "sources.zarr",
    "read_tiff_sequence": "sources.tiff",
    "convert": "workflow",
    "process": "workflow",
    "run": "workflow",
    "run_many": "workflow",
    "session": "workflow",
    "cleanup": "runtime",
}

__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    import importlib

    return getattr(importlib.import_module(f".{_PUBLIC[name]}", __name__), name)
