"""Stitching staged tiles into global labels: offsets, touching pairs, components, relabelling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import ImageMeta
from ..runtime import Materialized, materialize, small
from . import grid, kernels

#: Edges contracted together within a partition.
CHUNK_EDGES = 1 << 21
#: Tile numbers per range of the two-level running sum.
RANGE = 1 << 16


def tile_counts(staged: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Labels per tile: tile_id, n; with ``tiles``, those without labels have 0."""
    n = staged.groupBy("tile_id").agg(F.max("local").alias("n"))
    if tiles is None:
        return n
    return tiles.select("tile_id").join(n, "tile_id", "left").select("tile_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def offsets(counts: DataFrame, width: int = RANGE) -> DataFrame:
    """Exclusive running sum of n by tile_id: tile_id, offset.

    Two levels: sums within ranges of tile numbers run in parallel, and only
    one row per range is summed in one task.
    """
    part = F.floor(F.col("tile_id") / width)
    rows = counts.select("tile_id", F.col("n").cast("bigint").alias("n"), part.alias("_p"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_p").agg(F.sum("n").alias("s")).select("_p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_p").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, "_p").select("tile_id", (F.col("_base") + F.coalesce(F.sum("n").over(within), F.lit(0))).cast("bigint").alias("offset"))


def sequential(ids: DataFrame, column: str) -> DataFrame:
    """``column`` and seq = 1..n by value of the distinct ids.

    The ids are range-partitioned and numbered within their partition; one row
    per partition is summed in one task, however sparse the ids are. Nulls are
    left out.
    """
    rows = ids.select(F.col(column).cast("bigint").alias(column)).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    rows = materialize(rows.withColumn("_p", F.spark_partition_id()), "ranks")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_p").agg(F.count("*").alias("s")).select("_p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_p").orderBy(column)
    return rows.join(base, "_p").select(column, (F.col("_base") + F.row_number().over(within)).cast("bigint").alias("seq"))


def global_ids(staged: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Staged rows with label = local + offset of the tile.

    The offsets, one row per tile, are written once: every later scan of the
    labels joins them, and their size is then known.
    """
    base = materialize(offsets(counts if counts is not None else tile_counts(staged)), "offsets")
    return staged.join(small(base), "tile_id").withColumn("label", F.col("local") + F.col("offset")).drop("offset")


def touching_pairs(labels: DataFrame, meta: ImageMeta, label: str = "label") -> DataFrame:
    """Distinct pairs (lo, hi) of labels that meet across a tile face.

    Per axis, the voxels of the lower face are moved by one and joined with
    those of the upper face on all coordinates: an equi-join of faces only, of
    which a volume has few. Faces meet at their sides alone; voxels that touch
    at an edge or corner of tiles are not joined.
    """
    axes = list(meta.axes)
    rows = labels.filter(F.col(label) > 0).select(*axes, F.col(label).alias("label"))
    found = []
    for a, t, g in zip(axes, meta.tile, meta.grid):
        if g == 1:
            continue
        low = rows.filter((F.col(a) + 1) % t == 0).withColumn(a, F.col(a) + 1).withColumnRenamed("label", "_low")
        high = rows.filter(F.col(a) % t == 0)
        found.append(low.join(high, axes).filter(F.col("_low") != F.col("label")).select(F.least("_low", "label").alias("lo"), F.greatest("_low", "label").alias("hi")))
    if not found:
        return rows.sparkSession.createDataFrame([], "lo bigint, hi bigint")
    return reduce(DataFrame.unionByName, found).distinct()


def _star(edges: DataFrame, large: bool) -> Materialized:
    """One large-star or small-star step on edges (v > u), written: neighbours are linked to the least one instead.

    The least neighbours are written before the join, so that no aggregate
    stands between its shuffle and it, and adaptive execution splits a hot vertex.
    """
    near = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))) if large else edges
    led = Materialized(near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
    least = led.df
    linked = near.join(least, "v")
    moved = linked.filter("u > v" if large else "u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    own = least.filter("v <> m").select("v", F.col("m").alias("u"))
    out = Materialized(moved.unionByName(own).filter("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "edges")
    led.drop()
    return out


def _contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each chunk of a partition by stars around the least vertex of each piece."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        v, u = (edges.column(c).to_numpy() for c in ("v", "u"))
        ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        least = ids[kernels.least_linked(at[: len(v)], at[len(v) :], len(ids))]
        moved = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(least[moved])], names=["v", "u"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= chunk:
            yield stars()
            held = []
    if held:
        yield stars()


def _linked(edges: Materialized, max_rounds: int) -> Materialized:
    """Stars of whole components: large-star and small-star steps until no edge changes."""
    state = None
    for _ in range(max_rounds):
        mid = _star(edges.df, True)
        edges.drop()
        edges = _star(mid.df, False)
        mid.drop()
        r = edges.df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (before := state) == (state := (r["n"], r["h"])) and before is not None:
            return edges
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def components(pairs: DataFrame, lo: str = "lo", hi: str = "hi", max_rounds: int = 50, chunk: int = CHUNK_EDGES) -> DataFrame:
    """The least id that each paired id is linked with, directly or through others: old, rep.

    Ids that lie close together are mostly linked closely, so the edges are
    range-partitioned once and contracted within each partition, in chunks of
    bounded size. An id that lies in several chunks links its least ids there;
    these links alone are left. If they fit one chunk, they are contracted as
    one. Else alternating large-star and small-star steps join them; both keep
    one row per edge, so a large component is spread over many tasks. Ids
    without a pair are not in the result; they stand for themselves.
    """
    contract = partial(_contract, chunk=chunk)
    edges = pairs.filter(F.col(lo) != F.col(hi)).select(F.greatest(lo, hi).alias("v"), F.least(lo, hi).alias("u")).select(F.col("v").cast("bigint"), F.col("u").cast("bigint")).distinct()
    rows = materialize(edges.repartitionByRange("u", "v").mapInArrow(contract, "v bigint, u bigint"), "stars")
    ends = rows.select(F.explode(F.array("v", "u")).alias("id"), "u")
    shared = Materialized(ends.groupBy("id").agg(F.min("u").alias("m"), F.max("u").alias("x")).filter("m < x").select("id", "m"), "shared")
    links = Materialized(ends.join(small(shared.df), "id").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "links")
    shared.drop()
    n = links.df.count()
    if not n:
        return ends.select(F.col("id").alias("old"), F.col("u").alias("rep")).distinct()
    found = Materialized(links.df.coalesce(1).mapInArrow(contract, "v bigint, u bigint"), "linked") if n <= chunk else _linked(links, max_rounds)
    links.drop()
    least = small(found.df.select(F.col("v").alias("_u"), F.col("u").alias("_rep")))
    return ends.join(least, F.col("u") == F.col("_u"), "left").select(F.col("id").alias("old"), F.coalesce("_rep", "u").alias("rep")).distinct()


def lookup_table(pairs: DataFrame, max_label: int | None = None) -> DataFrame:
    """old, rep of the ids that are merged or lead a merge; pairs beyond ``max_label`` are left out."""
    if max_label is not None:
        pairs = pairs.filter(F.col("hi") <= max_label)
    return components(pairs)


def remap_count(lut: DataFrame) -> DataFrame:
    """One row ``n_remapped``: the ids that a lookup table gives another label."""
    return lut.agg(F.count_if(F.col("old") != F.col("rep")).alias("n_remapped"))


def relabel(labels: DataFrame, lut: DataFrame, label: str = "label", new: str = "rep") -> DataFrame:
    """Labels replaced through the table; those it does not hold stay. The table is broadcast if it is small."""
    table = small(lut.select(F.col("old").alias("_old"), F.col(new).alias("_new")))
    return labels.join(table, F.col(label) == F.col("_old"), "left").withColumn(label, F.coalesce("_new", label)).drop("_old", "_new")


def merge_labels(staged: DataFrame, meta: ImageMeta, counts: DataFrame | None = None, sequential_ids: bool = False) -> DataFrame:
    """Global labels of staged tiles: the axes and label; objects that meet across tile faces are one.

    The label of an object is the least of its parts, or with
    ``sequential_ids`` 1..n in that order. Nothing is changed in place, and the
    staged input is read from where it was materialised.
    """
    labels = global_ids(staged, counts)
    merged = relabel(labels, materialize(lookup_table(touching_pairs(labels, meta)), "lookup"))
    if sequential_ids:
        seq = sequential(merged, "label")
        merged = merged.join(small(seq.withColumnRenamed("label", "_l")), F.col("label") == F.col("_l")).withColumn("label", F.col("seq")).drop("_l", "seq")
    return merged.select(*meta.axes, F.col("label").cast("bigint"))


def tile_process(voxels: DataFrame, fn, meta: ImageMeta, sequential_ids: bool = False, **stage) -> DataFrame:
    """Run ``fn`` on every haloed tile once, stage its labels, and merge them into global ones."""
    from .staged import stage_tiles

    return merge_labels(materialize(stage_tiles(voxels, fn, meta, **stage), "staged"), meta, sequential_ids=sequential_ids)


def canonical(labels: DataFrame, meta: ImageMeta, label: str = "label") -> DataFrame:
    """Labels named by the least voxel number of their object, whatever the tiles and the numbering."""
    v: Column = grid.voxel_id(meta)
    # Written, so that it is broadcast where it is small, and a join with it is split at a hot object where it is not.
    name = materialize(labels.groupBy(label).agg(F.min(v).alias("comp")), "names")
    return labels.join(small(name), label).select(*meta.axes, "comp")


def object_count(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.filter(F.col(label) > 0).agg(F.countDistinct(label).alias("n_objects"))
