"""Splitting oversized items at natural boundaries, with overlap between consecutive pieces.

One greedy packer serves texts and tiles. Boundaries come in levels, the most
natural first; a piece ends at the last boundary, of the first level that has
any, that keeps it within the limit and brings the next piece forward. The last
level allows every position, so every item can be cut.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: The end of a piece in (low, high], or None if the level has no boundary there.
Level = Callable[[int, int], "int | None"]


def at_positions(positions: Sequence[int]) -> Level:
    """Boundaries at given sorted positions."""

    def last(low: int, high: int) -> int | None:
        i = bisect_right(positions, high)
        return positions[i - 1] if i and positions[i - 1] > low else None

    return last


def at_multiples(step: int) -> Level:
    """Boundaries at the multiples of ``step``."""

    def last(low: int, high: int) -> int | None:
        end = high // step * step
        return end if end > low else None

    return last


def anywhere(low: int, high: int) -> int | None:
    return high


def pack(length: int, limit: int, overlap: int, levels: Sequence[Level]) -> Iterator[tuple[int, int]]:
    """Pieces (from, to) of [0, length) of at most ``limit``; each starts ``overlap`` before the end of the one before.

    ``limit`` must exceed ``overlap``, else no further piece would come
    forward, and a ValueError is raised.
    """
    if limit <= overlap and length > limit:
        raise ValueError("the limit must exceed the overlap")
    start = 0
    while length - start > limit:
        end = next(e for level in (*levels, anywhere) if (e := level(start + overlap, start + limit)) is not None)
        yield start, end
        start = end - overlap
    yield start, length


# --- tiles -------------------------------------------------------------------


def parse_overlap(text: str | None, ndim: int) -> list[int] | None:
    """One width per axis, or None if the text is unusable.

    Null is 0 on every axis; else one integer for all axes or a list with one
    per axis, none negative.
    """
    if text is None:
        return [0] * ndim
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return None
    x = [x] * ndim if type(x) is int else x
    if not isinstance(x, list) or len(x) != ndim or any(type(v) is not int or v < 0 for v in x):
        return None
    return x


def tile_pieces(tile: list[int | None] | None, max_voxels: int | None, overlap: str | None, chunk: list[int | None] | None) -> tuple[str, list[tuple[int, int]]] | None:
    """The axis and the pieces of an oversized tile, or None if it is not to be cut.

    Not cut: a tile within ``max_voxels``, one without shape or limit, one with
    an unusable overlap, and one that cannot be cut within the limit along its
    longest axis (a piece would be no longer than its overlap).
    """
    if not tile or max_voxels is None or len(tile) > 3 or any(v is None or v <= 0 for v in tile) or math.prod(tile) <= max_voxels:
        return None
    halo = parse_overlap(overlap, len(tile))
    if halo is None:
        return None
    axis = tile.index(max(tile))
    n, h = tile[axis], halo[axis]
    w = max_voxels // (math.prod(tile) // n)
    if w <= h:
        return None
    step = chunk[axis] if chunk and len(chunk) == len(tile) else None
    levels = [at_multiples(step)] if step and step > 0 else []
    return "zyx"[3 - len(tile) + axis], list(pack(n, w, h, levels))


def split_tiles(tiles: DataFrame) -> DataFrame:
    """manifest_id, piece_no (from 1), axis, piece_from, piece_to of each oversized manifest.

    Repeated rows count once. The split is a narrow map; only manifests are
    shuffled, to drop repetitions.
    """
    schema = pa.schema([("manifest_id", pa.int64()), ("piece_no", pa.int32()), ("axis", pa.string()), ("piece_from", pa.int64()), ("piece_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for manifest, *plan in zip(*(batch.column(i).to_pylist() for i in range(5))):
                cut = tile_pieces(*plan)
                for no, (a, b) in enumerate(cut[1] if cut else (), 1):
                    for col, v in zip(cols, (manifest, no, cut[0], a, b)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = tiles.select("manifest_id", "tile_shape", "max_voxels", "overlap", "chunk_shape").distinct()
    return rows.mapInArrow(run, "manifest_id bigint, piece_no int, axis string, piece_from bigint, piece_to bigint")


# --- texts -------------------------------------------------------------------

#: Where a piece of text may end, the most natural first: before a section, after a paragraph, a sentence, a word (fixed values).
SEPARATORS = (
    re.compile(r"\n(?=diff --git |@@ |#{1,6} |={3,}|-{3,})"),
    re.compile(r"\r?\n[ \t]*\r?\n"),
    re.compile(r"[.!?。！？]+[\"')\]]*\s+|\r?\n"),
    re.compile(r"\s+"),
)


def text_pieces(text: str, limit: int, overlap: int, separators: Sequence[re.Pattern] = SEPARATORS) -> list[tuple[int, int]]:
    """Pieces of a text in characters; a text within the limit is one piece, an empty one has none."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    return list(pack(len(text), limit, overlap, [at_positions([m.end() for m in s.finditer(text)]) for s in separators]))


def split_texts(documents: DataFrame, limit: int = 1024, overlap: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece_no (from 1), piece_from, piece_to and piece of every text.

    Null and empty texts have no piece. Consecutive pieces share exactly
    ``overlap`` characters; every piece but the last ends at the most natural
    boundary within reach. A narrow map without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows += [(i, no, a, b, t[a:b]) for no, (a, b) in enumerate(text_pieces(t or "", limit, overlap), 1)]
            i, no, a, b, piece = zip(*rows) if rows else [()] * 5
            cols = [batch.column(0).take(pa.array(i, pa.int64())), pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(piece, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "piece_no", "piece_from", "piece_to", "piece"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, piece_no int, piece_from bigint, piece_to bigint, piece string")
