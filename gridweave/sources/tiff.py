"""TIFF planes: decoding with NumPy, calibration, and file sequences as voxels or chunks.

Strips and tiles, one sample per pixel or several, whole numbers and floats of 8
to 64 bits in either byte order, uncompressed or deflated, with or without the
horizontal predictor, classic and big files. Other compressions say so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units
from . import files

#: Tags of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 270, 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PLANAR, RESOLUTION_UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 282, 283, 284, 296, 317, 322, 323, 324, 325, 339
#: Bytes of a field type, and its NumPy type (fixed values).
FIELD = {1: "u1", 2: "S", 3: "u2", 4: "u4", 5: "2u4", 6: "i1", 7: "S", 8: "i2", 9: "i4", 10: "2i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}


class Plane:
    """One page of a TIFF file: its tags and, decoded on demand, its pixels."""

    def __init__(self, data: memoryview, order: str, tags: dict[int, object]):
        self.data, self.order, self.tags = data, order, tags

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if v is None else v[0] if isinstance(v, (list, np.ndarray)) else v

    @property
    def description(self) -> str | None:
        return self.tags.get(DESCRIPTION)

    def pixels(self) -> np.ndarray:
        """The pixels, (y, x) or (y, x, sample)."""
        width, height, samples = int(self.one(WIDTH)), int(self.one(HEIGHT)), int(self.one(SAMPLES, 1))
        if self.one(PLANAR, 1) != 1 and samples > 1:
            raise ValueError("planes with separate samples can not be read")
        kind = {1: "u", 2: "i", 3: "f"}.get(int(self.one(SAMPLE_FORMAT, 1)))
        bits = int(self.one(BITS, 1))
        if kind is None or bits not in (8, 16, 32, 64):
            raise ValueError(f"pixels of {bits} bits can not be read")
        dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        if TILES in self.tags:
            h, w = int(self.one(TILE_HEIGHT)), int(self.one(TILE_WIDTH))
            offsets, sizes = self.tags[TILES], self.tags[TILE_BYTES]
        else:
            h, w = min(int(self.one(ROWS, height)), height), width
            offsets, sizes = self.tags[STRIPS], self.tags[STRIP_BYTES]
        across = -(-width // w)
        out = np.zeros((height, width, samples), dtype.newbyteorder("="))
        for n, (at, size) in enumerate(zip(offsets, sizes)):
            y, x = n // across * h, n % across * w
            rows = h if TILES in self.tags else min(h, height - y)
            raw = np.frombuffer(self._unpacked(int(at), int(size)), dtype, rows * w * samples).reshape(rows, w, samples)
            if self.one(PREDICTOR, 1) == 2:
                raw = np.cumsum(raw, axis=1, dtype=out.dtype)
            part = out[y : y + rows, x : x + w]
            part[:] = raw[: part.shape[0], : part.shape[1]]
        return out[:, :, 0] if samples == 1 else out

    def _unpacked(self, at: int, size: int) -> bytes:
        raw = self.data[at : at + size]
        how = int(self.one(COMPRESSION, 1))
        if how == 1:
            return raw
        if how in (8, 32946):
            return zlib.decompress(raw)
        raise ValueError(f"TIFF compression {how} can not be read; known are none and deflate")

    def resolution_nm(self) -> dict[str, int]:
        """Nanometres per pixel of x and y from the resolution tags.

        Inch and centimetre are the units of the tag. Without one, the text of
        ImageJ may name the unit; else a bare resolution says nothing.
        """
        unit = {2: "inch", 3: "cm"}.get(int(self.one(RESOLUTION_UNIT, 2)))
        if unit is None and (self.description or "").lstrip().startswith("ImageJ="):
            found = units._UNIT.search(self.description)
            unit = units.unit_of(found[1]) or None if found else None
        out = {}
        for axis, tag in (("x", X_RESOLUTION), ("y", Y_RESOLUTION)):
            v = self.tags.get(tag)
            if unit and v is not None and len(v) == 2 and v[0] and v[1]:
                nm = units.size_nm(str(Decimal(int(v[1])) / Decimal(int(v[0]))), unit)
                if nm:
                    out[axis] = nm
        return out


def planes(data: bytes | memoryview) -> Iterator[Plane]:
    """The pages of a TIFF file."""
    data = memoryview(data)
    head = bytes(data[:4])
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    number = lambda at, kind: int(np.frombuffer(data[at : at + np.dtype(kind).itemsize], order + kind)[0])
    big = number(2, "u2") == 43
    if not big and number(2, "u2") != 42:
        raise ValueError("not a TIFF file")
    count_kind, entry, ref = ("u8", 20, "u8") if big else ("u2", 12, "u4")
    at, seen = number(8 if big else 4, ref), set()
    while at and at not in seen:
        seen.add(at)
        n, tags = number(at, count_kind), {}
        for i in range(n):
            e = at + np.dtype(count_kind).itemsize + i * entry
            tag, kind, count = number(e, "u2"), number(e + 2, "u2"), number(e + 4, ref)
            if kind not in FIELD:
                continue
            item = FIELD[kind]
            width = 1 if item == "S" else np.dtype(item.lstrip("2")).itemsize * (2 if item[0] == "2" else 1)
            place = e + 4 + np.dtype(ref).itemsize
            if width * count > np.dtype(ref).itemsize:
                place = number(place, ref)
            raw = bytes(data[place : place + width * count])
            if item == "S":
                tags[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
            else:
                tags[tag] = np.frombuffer(raw, order + item.lstrip("2")).tolist()
        yield Plane(data, order, tags)
        at = number(at + np.dtype(count_kind).itemsize + n * entry, ref)


def calibration_nm(plane: Plane) -> dict[str, int]:
    """axis -> nanometres, each from the first place that has it: OME-XML, ImageJ text and free text, resolution tags."""
    found: dict[str, int] = {}
    for axis, _, value, unit in units.size_texts(plane.description, None, None):
        if (nm := units.size_nm(value, unit)) is not None:
            found.setdefault(axis, nm)
    return plane.resolution_nm() | found


def sequence_planes(spark: SparkSession, path: str, pattern: str) -> tuple[DataFrame, list[str]]:
    """The files of a glob with their axes: path, content, the axes; and the names of the axes.

    The axes come from the file names by the named groups of ``pattern``; names
    that do not match are left out. One scan: contents are not shuffled.
    """
    rows = files.read_file_sequence(spark, path, pattern)
    return rows, [c for c in rows.columns if c in files.CANONICAL_AXES]


def read_tiff_sequence(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The voxels other than 0 of a file sequence: the axes of the names, y, x, value (double).

    Pages of one file count on along z (from 0), or, where the names give z
    already, must be one. A file that is no TIFF is an error that names it.
    """
    rows, axes = sequence_planes(spark, path, pattern)
    kept = [a for a in files.CANONICAL_AXES if a in {*axes, "y", "x"}] if "z" in axes else [a for a in files.CANONICAL_AXES if a in {*axes, "z", "y", "x"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(a).to_pylist() for a in axes]
            for i, (name, data) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content"))):
                try:
                    pages = [p.pixels() for p in planes(memoryview(data.as_buffer()))]
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from None
                if "z" in axes and len(pages) != 1:
                    raise ValueError(f"{name} has {len(pages)} pages, but its name gives its place along z")
                for z, a in enumerate(pages):
                    if a.ndim != 2:
                        raise ValueError(f"{name} has several samples per pixel")
                    y, x = np.nonzero(a)
                    known = {c: np.full(len(y), v[i], np.int32) for c, v in zip(axes, at)} | {"y": y, "x": x}
                    known.setdefault("z", np.full(len(y), z, np.int32))
                    cols = [pa.array(known[c].astype(np.int32)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(a[y, x].astype(np.float64))], names=[*kept, "value"])

    return rows.select("path", "content", *axes).mapInArrow(run, ", ".join(f"{a} int" for a in kept) + ", value double")


def sequence_calibration(spark: SparkSession, path: str) -> DataFrame:
    """path, axis, size_nm of the files of a glob, from their first page; files without a size give no row."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = next(planes(memoryview(data.as_buffer())), None)
                out += [(name, a, nm) for a, nm in sorted(calibration_nm(first).items())] if first else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["path", "axis", "size_nm"])

    return rows.mapInArrow(run, "path string, axis string, size_nm bigint")
