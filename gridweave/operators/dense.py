"""Dense images as chunk tables: one row per tile with a binary payload.

A voxel table costs tens of bytes per voxel, a chunk one to eight. Halos are
made by sending each chunk's margins to the neighbouring tiles, so the shuffle
carries the haloed image once, as bytes; what needs no halo is a narrow map. All
operators that work on voxel tables have their form here: staging, stitching,
relabelling, relations, occupancy, pyramids, growth and Gaussians.

A chunk that is 0 throughout may be absent. Rows with a null tile or payload are
left out; a tile must come once. Payloads are C-order bytes of the tile, clipped
to the image.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import planner
from ..meta import ImageMeta
from ..runtime import materialize, small
from . import grid, kernels, merge
from .staged import _box

CHUNKS = "tile_id bigint, payload binary"
_CHUNKS = pa.schema([("tile_id", pa.int64()), ("payload", pa.binary())])


def core_shape(meta: ImageMeta, tile: int) -> list[int]:
    lo, hi, _, _ = _box(meta, tile)
    return [y - x for x, y in zip(lo, hi)]


def _arrays(batch: pa.RecordBatch, meta: ImageMeta, dtype: str, column: str = "payload") -> Iterator[tuple[int, np.ndarray]]:
    """The chunks of a batch as arrays, without copying."""
    for tile, payload in zip(batch.column("tile_id").to_pylist(), batch.column(column)):
        yield tile, np.frombuffer(payload.as_buffer(), dtype).reshape(core_shape(meta, tile))


def _rows(cols, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def to_chunks(voxels: DataFrame, meta: ImageMeta, dtype: str = "uint16", value: str = "value") -> DataFrame:
    """Chunk rows (tile_id, payload) of a voxel table. Empty tiles have no row.

    Rows with a null coordinate or value, or outside the image, hold no voxel;
    a voxel that comes twice takes its greatest value.
    """
    axes = list(meta.axes)
    low = np.iinfo(dtype).min if np.issubdtype(np.dtype(dtype), np.integer) else -np.inf

    def pack(table: pa.Table) -> pa.Table:
        tile = table.column("tile_id")[0].as_py()
        lo, hi, _, _ = _box(meta, tile)
        a = np.full([y - x for x, y in zip(lo, hi)], low, dtype=dtype)
        at = tuple(table.column(c).to_numpy() - x for c, x in zip(axes, lo))
        np.maximum.at(a, at, table.column("value").to_numpy().astype(dtype))
        held = np.zeros(a.shape, bool)
        held[at] = True
        return pa.table({"tile_id": [tile], "payload": [np.where(held, a, 0).astype(dtype).tobytes()]})

    rows = voxels.select(*axes, F.col(value).alias("value")).dropna()
    for a, s in zip(axes, meta.shape):
        rows = rows.filter((F.col(a) >= 0) & (F.col(a) < s))
    return grid.assign_tiles(rows, meta).groupBy("tile_id").applyInArrow(pack, CHUNKS)


def to_voxels(chunks: DataFrame, meta: ImageMeta, dtype: str = "uint16", value: str = "value", zeros: bool = False) -> DataFrame:
    """The voxels other than 0 (or all) of a chunk table: the axes and the value; a narrow map."""
    axes, whole = list(meta.axes), not np.issubdtype(np.dtype(dtype), np.floating)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, dtype):
                place = np.nonzero(np.ones(a.shape, bool) if zeros else a)
                lo = _box(meta, tile)[0]
                cols = [pa.array((p + x).astype(np.int32)) for p, x in zip(place, lo)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(a[place].astype(np.int64 if whole else np.float64))], names=[*axes, value])

    ddl = ", ".join(f"{a} int" for a in axes) + f", {value} {'bigint' if whole else 'double'}"
    return chunks.select("tile_id", "payload").dropna().mapInArrow(run, ddl)


# --- halos --------------------------------------------------------------------


def _pieces(meta: ImageMeta, dtype: str):
    """Each chunk for its own tile, and its margins for the tiles whose halo reaches into it."""
    schema = pa.schema([("tile_id", pa.int64()), ("lo", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, dtype):
                lo, hi, _, _ = _box(meta, tile)
                near = []
                for x, y, t, h, g in zip(lo, hi, meta.tile, meta.halo, meta.grid):
                    near.append(range(max(0, x - h) // t, min((y - 1 + h) // t, g - 1) + 1))
                rows = []
                for index in itertools.product(*near):
                    other = sum(i * k for i, k in zip(index, meta.tile_steps))
                    _, _, low, high = _box(meta, other)
                    begin, end = [max(p, q) for p, q in zip(lo, low)], [min(p, q) for p, q in zip(hi, high)]
                    if all(p < q for p, q in zip(begin, end)):
                        part = a[tuple(slice(p - x, q - x) for p, q, x in zip(begin, end, lo))]
                        rows.append((other, begin, list(part.shape), part.tobytes()))
                yield _rows(zip(*rows), schema)

    return run


def map_haloed(chunks: DataFrame, fn: Callable[[int, np.ndarray], pa.Table], meta: ImageMeta, dtype: str, ddl: str, margins: bool = False) -> DataFrame:
    """``fn`` of the number and the haloed array of every tile; without a halo a narrow map.

    With ``margins``, tiles that have no chunk of their own but lie in reach of
    one are visited too.
    """
    rows = chunks.select("tile_id", "payload").dropna()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, dtype):
                yield from fn(tile, a).to_batches()

    def haloed(table: pa.Table) -> pa.Table:
        tile = table.column("tile_id")[0].as_py()
        _, _, low, high = _box(meta, tile)
        a = np.zeros([y - x for x, y in zip(low, high)], dtype=dtype)
        for begin, size, payload in zip(table.column("lo").to_pylist(), table.column("size").to_pylist(), table.column("payload").to_pylist()):
            a[tuple(slice(p - x, p - x + n) for p, x, n in zip(begin, low, size))] = np.frombuffer(payload, dtype).reshape(size)
        return fn(tile, a)

    if not any(meta.halo):
        return rows.mapInArrow(alone, ddl)
    parts = rows.mapInArrow(_pieces(meta, dtype), "tile_id bigint, lo array<int>, size array<int>, payload binary")
    if not margins:
        parts = parts.join(rows.select("tile_id"), "tile_id", "left_semi")
    return parts.groupBy("tile_id").applyInArrow(haloed, ddl)


def _core(meta: ImageMeta, tile: int, a: np.ndarray) -> np.ndarray:
    """The core of a haloed array."""
    lo, hi, low, _ = _box(meta, tile)
    return a[tuple(slice(p - x, q - x) for p, q, x in zip(lo, hi, low))]


# --- staging and stitching ----------------------------------------------------


def _labelled(fn: Callable, meta: ImageMeta, empty_threshold: float | None):
    def run(tile: int, a: np.ndarray) -> np.ndarray:
        labels = np.zeros(a.shape, np.int64) if empty_threshold is not None and a.max() <= empty_threshold else np.asarray(fn(a))
        if labels.shape != a.shape:
            raise ValueError(f"{getattr(fn, '__name__', fn)!r} returned shape {labels.shape} for tile {tile} of shape {a.shape}; it must give one label per input voxel")
        return kernels.dense_rank(_core(meta, tile, labels).astype(np.int64))

    return run


def stage_chunks(chunks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], meta: ImageMeta, dtype: str = "uint16", empty_threshold: float | None = None) -> DataFrame:
    """The labels of every tile of a chunk table, as ``stage_tiles`` gives them for voxels: tile_id, the axes, local.

    With ``empty_threshold``, haloed tiles whose greatest value does not exceed it do not run.
    """
    axes, label = list(meta.axes), _labelled(fn, meta, empty_threshold)

    def run(tile: int, a: np.ndarray) -> pa.Table:
        core, lo = label(tile, a), _box(meta, tile)[0]
        place = np.nonzero(core)
        cols = [pa.array(np.full(len(place[0]), tile)), *(pa.array((p + x).astype(np.int32)) for p, x in zip(place, lo)), pa.array(core[place])]
        return pa.Table.from_arrays(cols, names=["tile_id", *axes, "local"])

    return map_haloed(chunks, run, meta, dtype, f"tile_id bigint, {', '.join(f'{a} int' for a in axes)}, local bigint")


def stage_label_chunks(chunks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], meta: ImageMeta, dtype: str = "uint16", empty_threshold: float | None = None) -> DataFrame:
    """Label chunks (tile_id, payload of int64, n): the labels of every tile numbered 1..n; tiles without labels are left out."""
    label = _labelled(fn, meta, empty_threshold)

    def run(tile: int, a: np.ndarray) -> pa.Table:
        core = label(tile, a)
        n = int(core.max(initial=0))
        return pa.table({"tile_id": pa.array([tile] if n else [], pa.int64()), "payload": pa.array([core.tobytes()] if n else [], pa.binary()), "n": pa.array([n] if n else [], pa.int64())})

    return map_haloed(chunks, run, meta, dtype, f"{CHUNKS}, n bigint")


def touching_pairs(labels: DataFrame, meta: ImageMeta) -> DataFrame:
    """Distinct pairs (lo, hi) of labels that meet across a face of chunks of int64.

    Each chunk sends its upper face to the next tile and keeps its lower one;
    the two faces of a border meet in one group of two rows.
    """
    schema = pa.schema([("border", pa.int64()), ("axis", pa.int32()), ("payload", pa.binary())])

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile, a in _arrays(batch, meta, "int64"):
                for axis, (k, g) in enumerate(zip(meta.tile_steps, meta.grid)):
                    i = tile // k % g
                    if i:
                        rows.append((tile, axis, np.take(a, 0, axis).tobytes()))
                    if i < g - 1:
                        rows.append((tile + k, axis, np.take(a, -1, axis).tobytes()))
            yield _rows(zip(*rows) if rows else [[]] * 3, schema)

    def meet(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        a, b = (np.frombuffer(x, "int64") for x in table.column("payload").to_pylist())
        both = (a > 0) & (b > 0) & (a != b)
        pairs = np.unique(np.stack([np.minimum(a, b)[both], np.maximum(a, b)[both]], 1), axis=0)
        return pa.table({"lo": pairs[:, 0], "hi": pairs[:, 1]})

    rows = labels.select("tile_id", "payload").mapInArrow(faces, "border bigint, axis int, payload binary")
    return rows.groupBy("border", "axis").applyInArrow(meet, "lo bigint, hi bigint").distinct()


def relabel(labels: DataFrame, lut: DataFrame, meta: ImageMeta) -> DataFrame:
    """Chunks of int64 with their labels replaced through a table (old, rep); those it does not hold stay.

    Each chunk looks up its own labels alone: the table is never held as a whole.
    """
    schema = pa.schema([("tile_id", pa.int64()), ("old", pa.int64())])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, "int64"):
                ids = np.unique(a[a > 0])
                yield _rows([np.full(len(ids), tile), ids], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (tile, a), pairs in zip(_arrays(batch, meta, "int64"), batch.column("lut").to_pylist()):
                if pairs:
                    old, new = (np.array(x, np.int64) for x in zip(*sorted((p["old"], p["rep"]) for p in pairs)))
                    at = np.minimum(np.searchsorted(old, a), len(old) - 1)
                    a = np.where(old[at] == a, new[at], a)
                out.append((tile, a.tobytes()))
            yield _rows(zip(*out) if out else [[]] * 2, _CHUNKS)

    rows = labels.select("tile_id", "payload").dropna()
    mine = rows.mapInArrow(held, "tile_id bigint, old bigint").join(small(lut.select("old", "rep")), "old")
    mine = mine.groupBy("tile_id").agg(F.collect_list(F.struct("old", "rep")).alias("lut"))  # the labels of one tile
    return rows.join(mine, "tile_id", "left").select("tile_id", "payload", "lut").mapInArrow(apply, CHUNKS)


def merge_chunks(staged: DataFrame, meta: ImageMeta, sequential_ids: bool = False) -> DataFrame:
    """Global label chunks of ``stage_label_chunks``: labels that meet across a face are one.

    The label of an object is the least of its parts, or with
    ``sequential_ids`` 1..n in that order.
    """

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, np.where(a > 0, a + o, 0).tobytes()) for (t, a), o in zip(_arrays(batch, meta, "int64"), batch.column("offset").to_pylist())]
            yield _rows(zip(*out) if out else [[]] * 2, _CHUNKS)

    staged = materialize(staged, "staged-chunks")
    base = materialize(merge.offsets(staged.select("tile_id", "n")), "offsets")
    labels = materialize(staged.join(small(base), "tile_id").select("tile_id", "payload", "offset").mapInArrow(shift, CHUNKS), "label-chunks")
    out = relabel(labels, materialize(merge.lookup_table(touching_pairs(labels, meta)), "lookup"), meta)
    if sequential_ids:
        out = materialize(out, "label-chunks")
        seq = merge.sequential(label_ids(out, meta), "id").select(F.col("id").alias("old"), F.col("seq").alias("rep"))
        out = relabel(out, seq, meta)
    return out


def tile_process(chunks: DataFrame, fn: Callable, meta: ImageMeta, dtype: str = "uint16", sequential_ids: bool = False, empty_threshold: float | None = None) -> DataFrame:
    """Run ``fn`` on every haloed chunk once and merge the labels: label chunks of int64."""
    return merge_chunks(stage_label_chunks(chunks, fn, meta, dtype, empty_threshold), meta, sequential_ids)


def label_ids(labels: DataFrame, meta: ImageMeta, dtype: str = "int64") -> DataFrame:
    """The distinct labels (id) of label chunks; distinct within each chunk before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, a in _arrays(batch, meta, dtype):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(a[a > 0]).astype(np.int64))], names=["id"])

    return labels.select("tile_id", "payload").mapInArrow(run, "id bigint").distinct()


# --- relations and occupancy --------------------------------------------------


def overlap_counts(a: DataFrame, b: DataFrame, meta: ImageMeta, dtype: str = "int64") -> DataFrame:
    """a_id, b_id, n of labels that share voxels: chunks are joined by tile, pairs counted per chunk and then added up."""
    schema = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, x), (_, y) in zip(_arrays(batch, meta, dtype), _arrays(batch, meta, dtype, "other")):
                both = (x > 0) & (y > 0)
                pairs, n = np.unique(np.stack([x[both], y[both]], 1).astype(np.int64), axis=0, return_counts=True)
                yield _rows([pairs[:, 0], pairs[:, 1], n], schema)

    rows = a.select("tile_id", "payload").join(b.select("tile_id", F.col("payload").alias("other")), "tile_id")
    return rows.mapInArrow(run, "a_id bigint, b_id bigint, n bigint").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def block_max(chunks: DataFrame, meta: ImageMeta, block: tuple[int, ...], dtype: str = "uint16") -> DataFrame:
    """Greatest value per brick that holds a voxel other than 0: b<axis> for each axis, vmax; reduced per chunk, then across chunks that share a brick."""
    axes, whole = list(meta.axes), not np.issubdtype(np.dtype(dtype), np.floating)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, dtype):
                lo = _box(meta, tile)[0]
                first = [x // b for x, b in zip(lo, block)]
                cuts = [[0, *range((f + 1) * b - x, n, b)] for f, b, x, n in zip(first, block, lo, a.shape)]
                for axis, cut in enumerate(cuts):
                    a = np.maximum.reduceat(a, cut, axis=axis)
                place = np.nonzero(a)
                cols = [pa.array((p + f).astype(np.int32)) for p, f in zip(place, first)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(a[place].astype(np.int64 if whole else np.float64))], names=[*(f"b{x}" for x in axes), "vmax"])

    ddl = ", ".join(f"b{a} int" for a in axes) + f", vmax {'bigint' if whole else 'double'}"
    return chunks.select("tile_id", "payload").dropna().mapInArrow(run, ddl).groupBy(*(f"b{a}" for a in axes)).agg(F.max("vmax").alias("vmax"))


# --- pyramids, growth, Gaussians ----------------------------------------------


def level_meta(meta: ImageMeta, level: int, downscale: int = 2) -> ImageMeta:
    """The image of a pyramid level: in-plane axes shrink, chunks with them within cap and floor."""
    steps = [k**level for k in planner.strides("".join(meta.axes), downscale)]
    shape = tuple(-(-s // k) for s, k in zip(meta.shape, steps))
    tile = meta.tile if not level else planner.level_chunks(meta.tile, steps, "".join(meta.axes), shape)
    scale = {a: meta.scale[a] * k for a, k in zip(meta.axes, steps) if a in meta.scale}
    return replace(meta, shape=shape, tile=tile, halo=(0,) * len(shape), scale=scale)


def pyramid(chunks: DataFrame, meta: ImageMeta, dtype: str = "uint16", n_levels: int = 5, downscale: int = 2) -> DataFrame:
    """All levels of a chunk table from one scan: level, tile_id, payload; each chunk sends its strided part to every level's chunks."""
    if n_levels < 1 or downscale < 2:
        raise ValueError("a pyramid needs at least one level and a downscale of 2 or more")
    metas = [level_meta(meta, i, downscale) for i in range(n_levels)]
    steps = [[k**i for k in planner.strides("".join(meta.axes), downscale)] for i in range(n_levels)]
    schema = pa.schema([("level", pa.int32()), ("tile_id", pa.int64()), ("lo", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("payload", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, a in _arrays(batch, meta, dtype):
                lo = _box(meta, tile)[0]
                rows = []
                for level, (m, step) in enumerate(zip(metas, steps)):
                    part = a[tuple(slice(-x % k, None, k) for x, k in zip(lo, step))]
                    if not part.any():
                        continue
                    begin = [-(-x // k) for x, k in zip(lo, step)]
                    spans = [range(b // t, (b + n - 1) // t + 1) for b, n, t in zip(begin, part.shape, m.tile)]
                    for index in itertools.product(*spans):
                        at, end, _, _ = _box(m, sum(i * k for i, k in zip(index, m.tile_steps)))
                        p, q = [max(x, y) for x, y in zip(begin, at)], [min(x + n, y) for x, n, y in zip(begin, part.shape, end)]
                        piece = part[tuple(slice(x - b, y - b) for x, y, b in zip(p, q, begin))]
                        if piece.any():
                            rows.append((level, sum(i * k for i, k in zip(index, m.tile_steps)), [x - y for x, y in zip(p, at)], list(piece.shape), piece.tobytes()))
                yield _rows(zip(*rows) if rows else [[]] * 5, schema)

    def join(table: pa.Table) -> pa.Table:
        level, tile = (table.column(c)[0].as_py() for c in ("level", "tile_id"))
        a = np.zeros(core_shape(metas[level], tile), dtype=dtype)
        for begin, size, payload in zip(table.column("lo").to_pylist(), table.column("size").to_pylist(), table.column("payload").to_pylist()):
            a[tuple(slice(x, x + n) for x, n in zip(begin, size))] = np.frombuffer(payload, dtype).reshape(size)
        return pa.table({"level": pa.array([level], pa.int32()), "tile_id": [tile], "payload": [a.tobytes()]})

    rows = chunks.select("tile_id", "payload").dropna().mapInArrow(send, "level int, tile_id bigint, lo array<int>, size array<int>, payload binary")
    return rows.groupBy("level", "tile_id").applyInArrow(join, f"level int, {CHUNKS}")


def grow(labels: DataFrame, meta: ImageMeta, iterations: int = 1, dtype: str = "int64") -> DataFrame:
    """Label chunks grown by a box of side 2 * iterations + 1, clipped to the image; where they collide the larger wins."""
    wide = _full_halo(replace(meta), iterations)

    def run(tile: int, a: np.ndarray) -> pa.Table:
        core = _core(wide, tile, kernels.dilate(a, iterations))
        return pa.table({"tile_id": [tile], "payload": [core.astype(dtype).tobytes()]})

    return map_haloed(labels, run, wide, dtype, CHUNKS, margins=True)


def _full_halo(meta: ImageMeta, width: int) -> ImageMeta:
    """``meta`` with a halo on every axis, also on those of tiles of thickness 1, which staging leaves without."""
    object.__setattr__(meta, "halo", (width,) * len(meta.axes))
    return meta


def dog(chunks: DataFrame, meta: ImageMeta, low_sigma: float, high_sigma: float, dtype: str = "uint16") -> DataFrame:
    """Chunks of float64 of the difference of two Gaussians, mirrored at the edges of the image.

    The halo is the reach of the wider one, so that the borders of chunks leave
    no trace.
    """
    reach = max(len(kernels.gaussian_weights(s)) // 2 for s in (low_sigma, high_sigma))
    wide = _full_halo(replace(meta), reach)

    def run(tile: int, a: np.ndarray) -> pa.Table:
        x = a.astype(np.float64)
        core = _core(wide, tile, kernels.gaussian(x, low_sigma) - kernels.gaussian(x, high_sigma))
        return pa.table({"tile_id": [tile], "payload": [np.ascontiguousarray(core).tobytes()]})

    return map_haloed(chunks, run, wide, dtype, CHUNKS, margins=True)

