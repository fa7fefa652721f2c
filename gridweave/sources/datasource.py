"""``spark.read.format("ome_zarr")``: a Python data source for the levels of OME-Zarr stores."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import zarr

#: Bytes of chunk files that one task reads.
PARTITION_BYTES = 64 << 20


def _open(path: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _read(fs, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _level(path: str, level: int):
    """File system, folder, metadata and axes of a level, read without a JVM."""
    fs, base = _open(path.rstrip("/"))
    held = lambda p: fs.get_file_info(p).is_file
    if held(f"{base}/zarr.json"):
        version, attrs = 3, json.loads(_read(fs, f"{base}/zarr.json")).get("attributes", {})
    elif held(f"{base}/.zattrs"):
        version, attrs = 2, json.loads(_read(fs, f"{base}/.zattrs"))
    else:
        raise ValueError(f"{path} is no Zarr group with attributes")
    store = zarr.parse_store(path, version, attrs)
    if not 0 <= level < len(store.levels):
        raise ValueError(f"level {level} is not in {path}; it has 0 to {len(store.levels) - 1}")
    folder = f"{base}/{store.levels[level]}"
    info = zarr.parse_array(_read(fs, f"{folder}/{'zarr.json' if version == 3 else '.zarray'}").decode())
    return fs, folder, info, store.axes or info.dimensions or tuple(zarr.CANONICAL_AXES[-len(info.shape) :])


class OmeZarrSource(DataSource):
    """Voxels other than 0 of a level: the axes and value.

    Options: ``level`` (0), ``channel`` (then there is no column ``c``, and files
    of other channels are not read).
    """

    @classmethod
    def name(cls) -> str:
        return "ome_zarr"

    def _options(self) -> tuple[str, int, int | None]:
        channel = self.options.get("channel")
        return self.options["path"], int(self.options.get("level", 0)), None if channel is None else int(channel)

    def schema(self) -> str:
        path, level, channel = self._options()
        _, _, info, axes = _level(path, level)
        if channel is not None and ("c" not in axes or not 0 <= channel < info.shape[axes.index("c")]):
            raise ValueError(f"channel {channel} does not exist")
        kept = [a for a in axes if channel is None or a != "c"]
        return ", ".join(f"{a} int" for a in kept) + (", value bigint" if np.dtype(info.dtype).kind in "iub" else ", value double")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._options())


class _Reader(DataSourceReader):
    def __init__(self, path: str, level: int, channel: int | None):
        self.path, self.level, self.channel = path, level, channel

    def partitions(self) -> list[InputPartition]:
        """The files of the level in groups of ``PARTITION_BYTES``, from one listing of its folder."""
        from pyarrow import fs as pafs

        fs, folder, info, axes = _level(self.path, self.level)
        groups, size = [[]], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(folder, recursive=True)), key=lambda f: f.path):
            if not f.is_file or not f.base_name[-1:].isdigit():
                continue
            if self.channel is not None and info.index_of(f.path)[axes.index("c")] != self.channel // info.file_chunks[axes.index("c")]:
                continue
            if groups[-1] and size + f.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _, info, axes = _level(self.path, self.level)
        whole = np.dtype(info.dtype).kind in "iub"
        for path in partition.value:
            for index, a in zarr.decode_file(info, info.index_of(path), _read(fs, path)):
                at = [i * c for i, c in zip(index, info.chunks)]
                cut = [slice(0, max(0, min(c, s - p))) for c, s, p in zip(info.chunks, info.shape, at)]
                if self.channel is not None:
                    c = axes.index("c")
                    own = self.channel - at[c]
                    if not 0 <= own < info.chunks[c]:
                        continue
                    cut[c] = slice(own, own + 1)
                a = a[tuple(cut)]
                place = np.nonzero(a)
                cols = {x: pa.array((q + p + s.start).astype(np.int32)) for x, q, p, s in zip(axes, place, at, cut) if self.channel is None or x != "c"}
                yield pa.RecordBatch.from_pydict(cols | {"value": pa.array(a[place].astype(np.int64 if whole else np.float64))})


def register(spark) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(OmeZarrSource)
