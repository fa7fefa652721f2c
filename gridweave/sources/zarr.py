"""OME-Zarr stores (formats 2 and 3): scans, pyramids, labels and their metadata.

The chunk files of a level are read by the ``binaryFile`` source, so Spark lists
them and plans its tasks by bytes; a channel or region becomes a path pattern,
and other chunks are never opened. Tasks write each chunk or shard under another
name and rename it, so that a task may run twice. Metadata documents are small
and are read and written by the driver, last of all.
"""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import planner
from ..meta import ImageMeta
from ..operators import dense
from ..runtime import exists, glob_names, put_text, read_text

CANONICAL_AXES = "tczyx"
_EMPTY = (1 << 64) - 1
#: Kind of each axis in the metadata (fixed values).
AXIS_TYPE = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}


# --- codecs ---------------------------------------------------------------------


@lru_cache(1)
def _crc_table() -> list[int]:
    """Bytewise remainders of the Castagnoli polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0x82F63B78 if n & 1 else n >> 1
        table.append(n)
    return table


def crc32c(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def compress(data: bytes, codec: str | None, level: int = 3) -> bytes:
    if codec is None:
        return data
    if codec == "zstd":
        return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)
    if codec in ("gzip", "zlib"):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31 if codec == "gzip" else 15)
        return packer.compress(data) + packer.flush()
    raise ValueError(f"no codec {codec!r}; known are zstd, gzip, zlib and None")


def decompress(data: bytes, codec: str | None, size: int) -> bytes:
    if codec is None:
        return data
    if codec == "zstd":
        return pa.Codec("zstd").decompress(data, size, asbytes=True)
    if codec in ("gzip", "zlib"):
        return zlib.decompress(data, 47)
    raise ValueError(f"chunks of codec {codec!r} can not be read; known are zstd, gzip, zlib and none")


@dataclass(frozen=True)
class ArrayInfo:
    """What the metadata of an array says. ``file_chunks`` is what one file holds: a shard, or a chunk."""

    version: int
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    file_chunks: tuple[int, ...]
    dtype: str
    codec: str | None
    separator: str
    prefix: str = ""
    checksum: bool = False
    index_checksum: bool = False
    order: str = "C"
    dimensions: tuple[str, ...] | None = None

    @property
    def sharded(self) -> bool:
        return self.file_chunks != self.chunks

    def chunk_bytes(self) -> int:
        return math.prod(self.chunks) * np.dtype(self.dtype).itemsize

    def key(self, index: Sequence[int]) -> str:
        return self.prefix + self.separator.join(map(str, index))

    def index_of(self, path: str) -> tuple[int, ...]:
        """The place of a chunk file in the grid, from the end of its path."""
        n = len(self.shape)
        parts = path.split("/")[-n:] if self.separator == "/" else path.rsplit("/", 1)[-1].split(".")[-n:]
        return tuple(map(int, parts))


def _codecs_v3(codecs: list[dict], itemsize_one: bool) -> tuple[str | None, bool, str]:
    """(compressor, checksum, byte order) of a plain chain of codecs."""
    codec, checksum, endian = None, False, "<"
    for c in codecs:
        name, conf = c["name"], c.get("configuration") or {}
        if name == "bytes":
            endian = ">" if conf.get("endian") == "big" else "<"
        elif name in ("gzip", "zstd"):
            codec = name
        elif name == "crc32c":
            checksum = True
        elif name == "transpose" and list(conf.get("order", [])) == sorted(conf.get("order", [])):
            pass
        else:
            raise ValueError(f"arrays with the codec {name!r} can not be read")
    return codec, checksum, endian


def parse_array(text: str) -> ArrayInfo:
    """The metadata of an array, ``.zarray`` or ``zarr.json``. Only a fill value of 0 (or null) is taken: absent chunks are background."""
    doc = json.loads(text)
    if doc.get("fill_value") not in (0, 0.0, None, False):
        raise ValueError(f"fill value {doc['fill_value']!r}: absent chunks must be 0")
    shape = tuple(doc["shape"])
    if doc["zarr_format"] == 2:
        if doc.get("filters"):
            raise ValueError("arrays with filters can not be read")
        packer = doc.get("compressor")
        return ArrayInfo(2, shape, tuple(doc["chunks"]), tuple(doc["chunks"]), doc["dtype"], packer["id"] if packer else None, doc.get("dimension_separator", "."), order=doc.get("order", "C"))
    if doc.get("node_type") != "array":
        raise ValueError("not an array")
    outer = tuple(doc["chunk_grid"]["configuration"]["chunk_shape"])
    inner, codecs, index_codecs = outer, doc["codecs"], []
    if codecs[0]["name"] == "sharding_indexed":
        conf = codecs[0]["configuration"]
        if conf.get("index_location", "end") != "end":
            raise ValueError("shards with their index at the start can not be read")
        inner, index_codecs, codecs = tuple(conf["chunk_shape"]), conf.get("index_codecs", []), conf["codecs"]
    codec, checksum, endian = _codecs_v3(codecs, True)
    encoding = doc.get("chunk_key_encoding", {"name": "default"})
    default = encoding["name"] == "default"
    separator = (encoding.get("configuration") or {}).get("separator", "/" if default else ".")
    dtype = np.dtype(doc["data_type"]).newbyteorder(endian).str
    return ArrayInfo(
        3, shape, inner, outer, dtype, codec, separator, f"c{separator}" if default else "", checksum, any(c["name"] == "crc32c" for c in index_codecs),
        dimensions=tuple(doc["dimension_names"]) if doc.get("dimension_names") else None,
    )


def array_document(info: ArrayInfo, level: int = 3) -> tuple[str, str]:
    """File name and text of an array's metadata."""
    dtype = np.dtype(info.dtype)
    if info.version == 2:
        packer = {None: None, "zstd": {"id": "zstd", "level": level}, "gzip": {"id": "gzip", "level": level}, "zlib": {"id": "zlib", "level": level}}[info.codec]
        doc = {"zarr_format": 2, "shape": info.shape, "chunks": info.chunks, "dtype": dtype.str, "compressor": packer, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": info.separator}
        return ".zarray", json.dumps(doc, indent=1)
    if info.codec == "zlib":
        raise ValueError("format 3 has no zlib codec; use gzip")
    raw = {"name": "bytes", "configuration": {"endian": "big" if dtype.byteorder == ">" else "little"}}
    packer = {None: [], "zstd": [{"name": "zstd", "configuration": {"level": level, "checksum": False}}], "gzip": [{"name": "gzip", "configuration": {"level": level}}]}[info.codec]
    codecs = [raw, *packer]
    if info.sharded:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": info.chunks, "codecs": codecs, "index_codecs": index, "index_location": "end"}}]
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": info.shape, "data_type": dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": info.file_chunks}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": info.separator}}, "fill_value": 0, "codecs": codecs, "attributes": {},
    }
    if info.dimensions:
        doc["dimension_names"] = info.dimensions
    return "zarr.json", json.dumps(doc, indent=1)


def decode_chunk(info: ArrayInfo, data: bytes) -> np.ndarray:
    if info.checksum:
        data, given = data[:-4], int.from_bytes(data[-4:], "little")
        if crc32c(data) != given:
            raise ValueError("a chunk does not match its checksum")
    raw = decompress(data, info.codec, info.chunk_bytes())
    return np.frombuffer(raw, info.dtype).reshape(info.chunks, order=info.order)


def decode_file(info: ArrayInfo, index: Sequence[int], data: bytes) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(place of the chunk in the grid of chunks, chunk) of every chunk in a file."""
    if not info.sharded:
        yield tuple(index), decode_chunk(info, data)
        return
    per = [s // c for s, c in zip(info.file_chunks, info.chunks)]
    size = math.prod(per) * 16
    tail = data[len(data) - size - 4 * info.index_checksum :]
    if info.index_checksum and crc32c(tail[:-4]) != int.from_bytes(tail[-4:], "little"):
        raise ValueError("the index of a shard does not match its checksum")
    places = np.frombuffer(tail[:size], "<u8").reshape(-1, 2).tolist()
    for n, (offset, length) in zip(itertools.product(*map(range, per)), places):
        if offset != _EMPTY:
            yield tuple(i * k + j for i, k, j in zip(index, per, n)), decode_chunk(info, data[offset : offset + length])


def encode_shard(info: ArrayInfo, chunks: dict[tuple[int, ...], bytes]) -> bytes:
    """A shard from its encoded chunks by their place in it."""
    per = [s // c for s, c in zip(info.file_chunks, info.chunks)]
    body, places, at = [], [], 0
    for n in itertools.product(*map(range, per)):
        data = chunks.get(n)
        places.append((at, len(data)) if data is not None else (_EMPTY, _EMPTY))
        if data is not None:
            body.append(data)
            at += len(data)
    tail = np.array(places, "<u8").tobytes()
    return b"".join([*body, tail, crc32c(tail).to_bytes(4, "little")])


# --- stores ---------------------------------------------------------------------


@dataclass(frozen=True)
class Store:
    """The image of a store: its format, attributes, axes and the levels with their scale."""

    path: str
    version: int
    attributes: dict
    axes: tuple[str, ...]
    levels: tuple[str, ...]
    scales: tuple[tuple[float, ...] | None, ...]
    units: tuple[str | None, ...]
    name: str | None = None


def _attributes(spark: SparkSession, path: str) -> tuple[int, dict]:
    if exists(spark, f"{path}/zarr.json"):
        return 3, json.loads(read_text(spark, f"{path}/zarr.json")).get("attributes", {})
    if exists(spark, f"{path}/.zattrs"):
        return 2, json.loads(read_text(spark, f"{path}/.zattrs"))
    if exists(spark, f"{path}/.zgroup"):
        return 2, {}
    raise ValueError(f"{path} is no Zarr group")


def open_store(spark: SparkSession, path: str) -> Store:
    """The multiscale image at ``path``; its attributes may lie at top level (0.4) or under ``ome`` (0.5)."""
    path = path.rstrip("/")
    return parse_store(path, *_attributes(spark, path))


def parse_store(path: str, version: int, attrs: dict) -> Store:
    """The multiscale image that the attributes of a group describe."""
    body = attrs.get("ome", attrs)
    if not body.get("multiscales"):
        raise ValueError(f"{path} holds no multiscale image")
    image = body["multiscales"][0]
    axes = tuple(a if isinstance(a, str) else a["name"] for a in image.get("axes", ()))
    units = tuple(None if isinstance(a, str) else a.get("unit") for a in image.get("axes", ()))
    levels, scales = [], []
    for d in image["datasets"]:
        levels.append(str(d["path"]))
        scale = next((t["scale"] for t in d.get("coordinateTransformations", ()) if t.get("type") == "scale"), None)
        scales.append(tuple(map(float, scale)) if scale else None)
    return Store(path, version, attrs, axes, tuple(levels), tuple(scales), units, image.get("name"))


def level_info(spark: SparkSession, store: Store, level: int = 0) -> tuple[str, ArrayInfo]:
    """Path and metadata of a level; a level that is not there is an error that names those that are."""
    if not 0 <= level < len(store.levels):
        raise ValueError(f"level {level} is not in {store.path}; it has 0 to {len(store.levels) - 1}")
    path = f"{store.path}/{store.levels[level]}"
    name = next((n for n in ("zarr.json", ".zarray") if exists(spark, f"{path}/{n}")), None)
    if name is None:
        raise ValueError(f"level {level} of {store.path} has no array at {store.levels[level]}")
    return path, parse_array(read_text(spark, f"{path}/{name}"))


def image_meta(spark: SparkSession, path: str, level: int = 0, halo: int | Sequence[int] = 0) -> ImageMeta:
    """Axes, extent, chunks (as tiles) and calibration of a level."""
    store = open_store(spark, path)
    _, info = level_info(spark, store, level)
    axes = store.axes or info.dimensions or tuple(CANONICAL_AXES[-len(info.shape) :])
    scale = dict(zip(axes, store.scales[level] or ()))
    unit = next((u for u in store.units if u), "micrometer")
    return ImageMeta(axes, info.shape, tuple(min(c, s) for c, s in zip(info.chunks, info.shape)), halo or (0,) * len(axes), {a: v for a, v in scale.items() if a in "zyx"}, unit)


def _pattern(info: ArrayInfo, axes: Sequence[str], box: dict[str, tuple[int, int]]) -> str:
    """The path pattern of the files that a box (axis: half-open range) may touch."""
    parts = []
    for a, s, c in zip(axes, info.shape, info.file_chunks):
        lo, hi = box.get(a, (0, s))
        first, last = max(0, lo) // c, (min(s, hi) - 1) // c
        whole = first == 0 and last == (s - 1) // c
        parts.append("*" if whole else "{" + ",".join(map(str, range(first, last + 1))) + "}")
    return info.key(parts)


def read_files(spark: SparkSession, path: str, info: ArrayInfo, axes: Sequence[str], box: dict[str, tuple[int, int]]) -> DataFrame | None:
    """path, content of the chunk files in reach of a box; None where there are none."""
    if any(min(hi, s) <= max(0, lo) for (lo, hi), s in ((box.get(a, (0, s)), s) for a, s in zip(axes, info.shape))):
        return None
    pattern = f"{path}/{_pattern(info, axes, box)}"
    if not glob_names(spark, pattern):
        return None
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def _select(spark, path, level, channel, lo, hi):
    store = open_store(spark, path)
    where, info = level_info(spark, store, level)
    axes = store.axes or info.dimensions or tuple(CANONICAL_AXES[-len(info.shape) :])
    box = {a: (max(0, x), min(s, y)) for a, s, x, y in zip(axes, info.shape, lo or [0] * len(axes), hi or info.shape)}
    if channel is not None:
        if "c" not in axes:
            if channel > 0:
                raise ValueError(f"the image has no channel axis; channel {channel} does not exist")
        else:
            n = info.shape[axes.index("c")]
            if not 0 <= channel < n:
                raise ValueError(f"channel {channel} does not exist; the image has {n}")
            box["c"] = (channel, channel + 1)
    return where, info, axes, box


def read_zarr(spark: SparkSession, path: str, level: int = 0, channel: int | None = None, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None) -> DataFrame:
    """The voxels other than 0 of a level: the axes (without ``c`` if a channel is chosen) and value.

    ``lo`` and ``hi`` bound a half-open box over all axes. Chunks outside of it
    or of other channels are not read.
    """
    where, info, axes, box = _select(spark, path, level, channel, lo, hi)
    kept = [a for a in axes if channel is None or a != "c"]
    whole = np.dtype(info.dtype).kind in "iub"
    ddl = ", ".join(f"{a} int" for a in kept) + f", value {'bigint' if whole else 'double'}"
    rows = read_files(spark, where, info, axes, box)
    if rows is None:
        return spark.createDataFrame([], ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for index, a in decode_file(info, info.index_of(name), memoryview(data.as_buffer())):
                    at = [i * c for i, c in zip(index, info.chunks)]
                    cut = [slice(max(box[x][0] - p, 0), max(0, min(box[x][1] - p, c))) for x, p, c in zip(axes, at, info.chunks)]
                    a = a[tuple(cut)]
                    place = np.nonzero(a)
                    cols = [pa.array((q + p + s.start).astype(np.int32)) for q, p, s, x in zip(place, at, cut, axes) if x in kept]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(a[place].astype(np.int64 if whole else np.float64))], names=[*kept, "value"])

    return rows.mapInArrow(run, ddl)


def read_zarr_chunks(spark: SparkSession, path: str, level: int = 0, channel: int | None = None, halo: int | Sequence[int] = 0) -> tuple[DataFrame, ImageMeta, str]:
    """A level as a chunk table, its image and its type: the chunks are the tiles, the store's bytes the payload.

    A channel axis, and a time axis of one point, are taken off; with a channel
    axis the channel has to be chosen.
    """
    where, info, axes, box = _select(spark, path, level, channel, None, None)
    whole = image_meta(spark, path, level)
    leading = tuple(a for a in axes if a in "tc")
    if any(box[a][1] - box[a][0] > 1 for a in leading):
        raise ValueError(f"choose one of the points of {', '.join(leading)} first")
    keep = [i for i, a in enumerate(axes) if a not in leading]
    pick = lambda x: tuple(x[i] for i in keep)
    meta = replace(whole, axes=pick(axes), shape=pick(info.shape), tile=pick(whole.tile), halo=halo or (0,) * len(keep))
    dtype = np.dtype(info.dtype).newbyteorder("=").str
    rows = read_files(spark, where, info, axes, box)
    if rows is None:
        return spark.createDataFrame([], dense.CHUNKS), meta, dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for index, a in decode_file(info, info.index_of(name), memoryview(data.as_buffer())):
                    at = [box[x][0] - i * c for x, i, c in zip(axes, index, info.chunks)]
                    if any(not 0 <= at[i] < info.chunks[i] for i, x in enumerate(axes) if x in leading):
                        continue
                    a = a[tuple(at[i] if x in leading else slice(None) for i, x in enumerate(axes))]
                    tile = sum(index[i] * k for i, k in zip(keep, meta.tile_steps))
                    a = a[tuple(slice(0, n) for n in dense.core_shape(meta, tile))]
                    out.append((tile, np.ascontiguousarray(a, dtype).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 2, (pa.int64(), pa.binary()))], names=["tile_id", "payload"])

    return rows.mapInArrow(run, dense.CHUNKS), meta, dtype


# --- writing --------------------------------------------------------------------


def _write_file(folder: str, key: str, data: bytes) -> None:
    """One file under another name first, then renamed: a task that runs twice leaves the same."""
    import uuid

    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(folder)
    target = f"{base}/{key}"
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, target)


def write_level(chunks: DataFrame, folder: str, meta: ImageMeta, dtype: str, info: ArrayInfo, level: int = 3) -> tuple[int, int]:
    """Write a chunk table whose tiles are the chunks of ``info``; returns the number of files and of bytes.

    Chunks that are 0 throughout are not written. A shard is put together in
    one task from its encoded chunks.
    """
    uri = folder if "://" in folder else ("file://" + folder.removeprefix("file:"))
    index_of = lambda tile: tuple(tile // k % g for k, g in zip(meta.tile_steps, meta.grid))

    def encode(tile: int, payload) -> bytes | None:
        a = np.frombuffer(payload, dtype).reshape(dense.core_shape(meta, tile))
        if not a.any():
            return None
        full = np.zeros(info.chunks, info.dtype)
        full[tuple(slice(0, n) for n in a.shape)] = a
        return compress(full.tobytes(), info.codec, level)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for tile, payload in zip(batch.column("tile_id").to_pylist(), batch.column("payload")):
                if (data := encode(tile, payload.as_buffer())) is not None:
                    _write_file(uri, info.key(index_of(tile)), data)
                    sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["bytes"])

    per = [max(1, f // c) for f, c in zip(info.file_chunks, info.chunks)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile, payload in zip(batch.column("tile_id").to_pylist(), batch.column("payload")):
                if (data := encode(tile, payload.as_buffer())) is not None:
                    index = index_of(tile)
                    rows.append((info.key([i // k for i, k in zip(index, per)]), [i % k for i, k in zip(index, per)], data))
            cols = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.binary()))], names=["file", "place", "data"])

    def shard(table: pa.Table) -> pa.Table:
        data = encode_shard(info, {tuple(p): d for p, d in zip(table.column("place").to_pylist(), table.column("data").to_pylist())})
        _write_file(uri, table.column("file")[0].as_py(), data)
        return pa.table({"bytes": [len(data)]})

    rows = chunks.select("tile_id", "payload").dropna()
    if info.sharded:
        written = rows.mapInArrow(packed, "file string, place array<int>, data binary").groupBy("file").applyInArrow(shard, "bytes bigint")
    else:
        written = rows.mapInArrow(plain, "bytes bigint")
    r = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def multiscales(metas: Sequence[ImageMeta], name: str | None, base: dict[str, float], version: str) -> list[dict]:
    """The multiscales document of a pyramid; axes without a known scale count as 1."""
    first = metas[0]
    axes = [{"name": a, "type": AXIS_TYPE.get(a, "space")} | ({"unit": first.unit} if AXIS_TYPE.get(a, "space") == "space" and a in base else {}) for a in first.axes]
    sets = []
    for i, m in enumerate(metas):
        scale = [float(base.get(a, 1.0)) * round(s0 / s) if s else 1.0 for a, s0, s in zip(first.axes, first.shape, m.shape)]
        sets.append({"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": scale}]})
    doc = {"axes": axes, "datasets": sets} | ({"name": name} if name else {})
    return [doc | ({"version": version} if version == "0.4" else {})]


def write_attributes(spark: SparkSession, path: str, version: int, update: dict) -> None:
    """Set attributes of a group; other keys stay as they are. In format 3 they belong under ``ome``."""
    if version == 2:
        old = json.loads(read_text(spark, f"{path}/.zattrs")) if exists(spark, f"{path}/.zattrs") else {}
        put_text(spark, f"{path}/.zgroup", json.dumps({"zarr_format": 2}))
        put_text(spark, f"{path}/.zattrs", json.dumps(old | update, indent=1))
        return
    old = json.loads(read_text(spark, f"{path}/zarr.json")) if exists(spark, f"{path}/zarr.json") else {"zarr_format": 3, "node_type": "group", "attributes": {}}
    ome = old.setdefault("attributes", {}).get("ome", {}) | update | {"version": "0.5"}
    old["attributes"]["ome"] = ome
    put_text(spark, f"{path}/zarr.json", json.dumps(old, indent=1))


def write_zarr(
    chunks: DataFrame,
    path: str,
    meta: ImageMeta,
    dtype: str = "uint16",
    n_levels: int = 5,
    downscale: int = 2,
    version: int = 2,
    codec: str | None = "zstd",
    shard: bool | Sequence[int] = False,
    name: str | None = None,
    overwrite: bool = False,
    attributes: dict | None = None,
) -> Store:
    """Write a chunk table as a multiscale image with all its levels; the metadata comes last and makes it visible.

    ``meta.scale`` is the pixel size. ``shard`` is True for shards of about
    512 MB, or a shape (format 3 alone). A level of very many files brings a
    warning. An image that is there already is an error, unless ``overwrite``.
    """
    from ..runtime import remove

    spark = chunks.sparkSession
    path = path.rstrip("/")
    if shard and version != 3:
        raise ValueError("shards need format 3")
    if exists(spark, path) and (exists(spark, f"{path}/.zattrs") or exists(spark, f"{path}/zarr.json")):
        if not overwrite:
            raise FileExistsError(f"{path} exists")
        remove(spark, path)
    metas = write_levels(chunks, path, meta, dtype, 0, n_levels, downscale, version, codec, shard)
    body = {"multiscales": multiscales(metas, name, meta.scale, "0.4" if version == 2 else "0.5")}
    write_attributes(spark, path, version, body | (attributes or {}))
    return open_store(spark, path)


def write_levels(chunks, path, meta, dtype, first, n_levels, downscale, version, codec, shard=False) -> list[ImageMeta]:
    """Write the levels from ``first`` on, all from level 0 in one pass; returns the images of all levels."""
    from ..runtime import Materialized

    spark = chunks.sparkSession
    metas = [dense.level_meta(meta, i, downscale) for i in range(n_levels)]
    levels = Materialized(dense.pyramid(chunks, meta, dtype, n_levels, downscale), "levels", ["level"])
    for i in range(first, n_levels):
        m, item = metas[i], np.dtype(dtype).itemsize
        wanted = planner.auto_shard(m.tile, m.shape, item) if shard is True else planner.fit_shard(shard, m.tile, m.shape) if shard else m.tile
        planner.chunk_count(m.shape, m.tile, bool(shard))
        info = ArrayInfo(version, m.shape, m.tile, tuple(wanted), np.dtype(dtype).newbyteorder("<").str, codec, "/", "c/" if version == 3 else "", index_checksum=bool(shard), dimensions=m.axes if version == 3 else None)
        write_level(levels.df.filter(F.col("level") == i), f"{path}/{i}", m, dtype, info)
        put_text(spark, "/".join([f"{path}/{i}", array_document(info)[0]]), array_document(info)[1])
    levels.drop()
    return metas


def add_pyramid(spark: SparkSession, path: str, n_levels: int = 5, downscale: int = 2, codec: str | None = "zstd") -> Store:
    """Add the levels above 0 to a store; level 0 is read and stays, higher levels are written anew."""
    store = open_store(spark, path)
    where, info, axes, box = _select(spark, path, 0, None, None, None)
    meta = image_meta(spark, path)
    rows = read_files(spark, where, info, axes, box)
    dtype = np.dtype(info.dtype).newbyteorder("=").str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for index, a in decode_file(info, info.index_of(name), memoryview(data.as_buffer())):
                    tile = sum(i * k for i, k in zip(index, meta.tile_steps))
                    out.append((tile, np.ascontiguousarray(a[tuple(slice(0, n) for n in dense.core_shape(meta, tile))], dtype).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 2, (pa.int64(), pa.binary()))], names=["tile_id", "payload"])

    chunks = rows.mapInArrow(run, dense.CHUNKS) if rows is not None else spark.createDataFrame([], dense.CHUNKS)
    metas = write_levels(chunks, path.rstrip("/"), meta, dtype, 1, n_levels, downscale, store.version, codec)
    base = dict(zip(store.axes, store.scales[0] or ()))
    write_attributes(spark, path.rstrip("/"), store.version, {"multiscales": multiscales(metas, store.name, base, "0.4" if store.version == 2 else "0.5")})
    return open_store(spark, path)


# --- labels ---------------------------------------------------------------------


def write_zarr_labels(
    labels: DataFrame, path: str, meta: ImageMeta, name: str = "labels", dtype: str = "int64", n_levels: int = 5, downscale: int = 2, codec: str | None = "zstd", overwrite: bool = False, n_objects: int | None = None
) -> Store:
    """Write label chunks under ``labels/<name>`` of an image store and register them.

    Format and calibration are those of the image, axis by axis, where ``meta``
    does not say otherwise.
    """
    spark = labels.sparkSession
    path = path.rstrip("/")
    image = open_store(spark, path)
    held = {a: s for a, s in zip(image.axes, image.scales[0] or ()) if a in meta.axes}
    unit = next((u for u in image.units if u), meta.unit)
    meta = replace(meta, scale=held | meta.scale, unit=unit)
    mark = {"image-label": {"source": {"image": "../../"}} | ({"n_objects": n_objects} if n_objects is not None else {})}
    out = write_zarr(labels, f"{path}/labels/{name}", meta, dtype, n_levels, downscale, image.version, codec, name=name, overwrite=overwrite, attributes=mark)
    register_zarr_labels(spark, path, name)
    return out


def zarr_label_names(spark: SparkSession, path: str) -> list[str]:
    """The registered label images of a store."""
    folder = f"{path.rstrip('/')}/labels"
    if not any(exists(spark, f"{folder}/{n}") for n in ("zarr.json", ".zattrs", ".zgroup")):
        return []
    attrs = _attributes(spark, folder)[1]
    return list(attrs.get("ome", attrs).get("labels", []))


def register_zarr_labels(spark: SparkSession, path: str, name: str) -> None:
    """Name a label image in the registry of its store; doing it again changes nothing.

    The registry is read and put in place anew by one rename: sinks of one
    store that end at the same moment need to be registered one after another.
    """
    names = zarr_label_names(spark, path)
    if name not in names:
        write_attributes(spark, f"{path.rstrip('/')}/labels", open_store(spark, path).version, {"labels": [*names, name]})


def zarr_layers(spark: SparkSession, path: str) -> DataFrame:
    """What a viewer would show of a store: kind, name, level, path, axes, scale, unit of every level of the image and its labels."""
    out = []
    for kind, name in [("image", ""), *(("labels", n) for n in zarr_label_names(spark, path))]:
        store = open_store(spark, f"{path.rstrip('/')}/labels/{name}" if name else path)
        for level, (where, scale) in enumerate(zip(store.levels, store.scales)):
            out.append((kind, name or store.name, level, f"{store.path}/{where}", list(store.axes), list(scale) if scale else None, next((u for u in store.units if u), None)))
    return spark.createDataFrame(out, "kind string, name string, level int, path string, axes array<string>, scale array<double>, unit string")
