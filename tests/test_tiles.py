"""The tile engine against whole-image NumPy, for random shapes, tiles and halos, and the fixed cases."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave import workflow
from gridweave.meta import ImageMeta
from gridweave.operators import grid, kernels, merge, occupancy, pyramid, relations, staged
from gridweave.sources import files

AXES = {2: ("y", "x"), 3: ("z", "y", "x")}


#: Workers import the library, not the tests.
fn = partial(kernels.threshold_label, threshold=0, connectivity="face")


def dense(df, shape, value="label"):
    out = np.zeros(shape, dtype=np.int64)
    for r in df.collect():
        out[tuple(r[a] for a in AXES[len(shape)])] = r[value]
    return out


def same_partition(a, b):
    """Equal up to renumbering."""
    assert ((a > 0) == (b > 0)).all()
    pairs = set(zip(a[a > 0].tolist(), b[a > 0].tolist()))
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def run(spark, a, tile, halo=0, f=fn, **kw):
    meta = ImageMeta(AXES[a.ndim], a.shape, tile, halo)
    return dense(merge.tile_process(files.from_array(spark, a, "".join(meta.axes)), f, meta, **kw), a.shape)


@settings(max_examples=5, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(2, 3), st.integers(1, 5), st.integers(0, 3), st.floats(0.1, 0.5))
def test_tile_and_merge_is_whole_image_labelling(spark, seed, ndim, tile, halo, density):
    rng = np.random.default_rng(seed)
    a = (rng.random(rng.integers(3, 12, ndim)) < density).astype(np.int64)
    a.ravel()[0] = 1
    same_partition(run(spark, a, (tile,) * ndim, halo), kernels.connected_components(a > 0))


def test_block_across_a_border_is_one_object(spark):
    a = np.zeros((2, 20, 45), int)
    a[1, 3:19, 11:34] = 70
    assert set(np.unique(run(spark, a, (1, 10, 15), 3, sequential_ids=True))) == {0, 1}


def test_sequential_ids_have_no_gap(spark):
    rng = np.random.default_rng(1)
    out = run(spark, (rng.random((2, 32, 32)) > 0.7).astype(int), (1, 32, 32), sequential_ids=True)
    assert set(np.unique(out)) == set(range(out.max() + 1))


def test_full_tile_keeps_its_label_and_diagonals_stay_apart(spark):
    assert (run(spark, np.ones((4, 4), int), (2, 2), sequential_ids=True) == 1).all()
    a = np.zeros((4, 4), int)
    a[1, 1] = a[2, 2] = 1
    assert run(spark, a, (2, 2), sequential_ids=True).max() == 2


def test_transitive_and_separate_labels(spark):
    # Five tiles in a row, each full of its own label: one object. Without the middle tile: two.
    meta = ImageMeta(("y", "x"), (3, 10), (3, 2))
    rows = spark.range(30).selectExpr("CAST(id div 10 AS int) AS y", "CAST(id % 10 AS int) AS x", "id % 10 div 2 AS tile_id", "1L AS local")
    assert merge.merge_labels(rows, meta).select("label").distinct().count() == 1
    assert merge.merge_labels(rows.filter("tile_id <> 2"), meta).select("label").distinct().count() == 2


def test_halo_width_does_not_change_the_result(spark):
    rng = np.random.default_rng(6)
    a = (rng.random((3, 14, 18)) > 0.6).astype(int)
    first = run(spark, a, (3, 7, 6))
    for halo in (5, [0, 2, 4]):
        same_partition(run(spark, a, (3, 7, 6), halo), first)


def test_nulls_outside_and_repeats(spark):
    meta = ImageMeta(("y", "x"), (4, 4), (2, 2))
    rows = spark.createDataFrame([(0, 0, 5), (0, 0, 5), (None, 1, 5), (1, None, 5), (1, 1, None), (9, 9, 5), (-1, 0, 5)], "y int, x int, value int")
    assert [tuple(r) for r in staged.stage_tiles(rows, fn, meta).collect()] == [(0, 0, 0, 1)]
    assert staged.stage_tiles(rows.limit(0), fn, meta).count() == 0
    assert merge.tile_process(rows.limit(0), fn, meta).count() == 0


def test_wrong_shape_is_an_error(spark):
    meta = ImageMeta(("y", "x"), (4, 4), (2, 2))
    rows = spark.createDataFrame([(0, 0, 5)], "y int, x int, value int")
    with pytest.raises(Exception, match="one label per input voxel"):
        staged.stage_tiles(rows, lambda t: t[:1], meta).collect()


def test_empty_tiles_do_not_run(spark):
    a = np.zeros((4, 32, 32), int)
    a[:2] = 5
    a[2:] = 1000
    meta = ImageMeta(("z", "y", "x"), a.shape, (1, 32, 32))
    calls = spark.sparkContext.accumulator(0)

    def counted(tile):
        calls.add(1)
        return fn(tile)

    staged.stage_tiles(files.from_array(spark, a, "zyx"), counted, meta, empty_threshold=100).count()
    assert calls.value == 2
    # A bright voxel in the halo alone makes a tile run, unless its core is asked for.
    b = np.zeros((8, 8), int)
    b[:4, :4], b[3, 4] = 5, 1000
    meta = ImageMeta(("y", "x"), b.shape, (4, 4), 1)
    for scope, tiles in (("haloed", {0, 1}), ("core", {1})):
        rows = staged.stage_tiles(files.from_array(spark, b, "yx"), fn, meta, empty_threshold=100, empty_scope=scope)
        assert {r["tile_id"] for r in rows.collect()} == tiles


def test_functions_of_all_channels(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (3, 12, 15))
    meta = ImageMeta(("y", "x"), a.shape[1:], (5, 6), 2)
    rows = files.from_array(spark, a, "cyx")
    want = kernels.connected_components(a.sum(0) > 3)
    for axis in (0, 2):
        f = partial(kernels.channel_label, threshold=3, channel_axis=axis)
        got = dense(merge.tile_process(rows, f, meta, channels=3, channel_axis=axis), want.shape)
        same_partition(got, want)


def test_one_tile_at_a_time(spark, tmp_path):
    rng = np.random.default_rng(4)
    a = (rng.random((9, 11)) > 0.5).astype(int)
    meta = ImageMeta(("y", "x"), a.shape, (4, 5), 1)
    rows = files.from_array(spark, a, "yx")
    want = {r["tile_id"]: r["n"] for r in merge.tile_counts(staged.stage_tiles(rows, fn, meta)).collect()}
    path = f"file://{tmp_path}/stage"
    for _ in range(2):
        assert {t: staged.stage_tile(rows, fn, meta, t, path) for t in (0, 4, 8)} == {t: want.get(t, 0) for t in (0, 4, 8)}
    assert spark.read.parquet(path).groupBy("tile_id").agg(F.max("local").alias("n")).count() == 3
    with pytest.raises(ValueError):
        staged.stage_tile(rows, fn, meta, 9, path)


def test_offsets_and_sequential_ranks_across_ranges(spark):
    n = [3, 0, 2, 7, 1]
    counts = spark.createDataFrame(list(enumerate(n)), "tile_id bigint, n bigint")
    assert [r["offset"] for r in merge.offsets(counts, width=2).orderBy("tile_id").collect()] == [0, 3, 3, 5, 12]
    ids = spark.createDataFrame([(v,) for v in (500, 7, 1000, 7)], "v bigint")
    assert {r["v"]: r["seq"] for r in merge.sequential(ids, "v").collect()} == {7: 1, 500: 2, 1000: 3}


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (201, 200), (200, 201), (None, 3), (3, None)]
    got = {r["old"]: r["rep"] for r in merge.components(spark.createDataFrame(pairs, "lo bigint, hi bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert merge.components(spark.createDataFrame([], "lo bigint, hi bigint")).count() == 0


@pytest.fixture
def small_partitions(spark):
    """Small inputs stay in as many partitions as large ones have."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("chunk", [merge.CHUNK_EDGES, 8])
def test_components_across_partitions(spark, small_partitions, chunk):
    """What links the partitions fits one chunk, or goes through the star steps."""
    order = np.random.default_rng(3).permutation(np.arange(1, 81)).tolist()
    pairs = [*zip(order, order[1:])] + [(k, 5000) for k in range(100, 140)] + [(200, 300), (300, 400), (400, 200), (2, 1), (900, 901)]
    got = [tuple(r) for r in merge.components(spark.createDataFrame(pairs, "lo bigint, hi bigint"), chunk=chunk).select("old", "rep").collect()]
    want = {i: 1 for i in range(1, 81)} | {k: 100 for k in [*range(100, 140), 5000]} | {200: 200, 300: 200, 400: 200, 900: 900, 901: 900}
    assert len(got) == len(want) and dict(got) == want


def test_components_name_an_id_of_several_partitions_once(spark, small_partitions):
    """2 and 3 lie with the same least id in the first partition and in the last."""
    pairs = [(1, k) for k in range(2, 82)] + [(2, 81), (3, 81)]
    got = [tuple(r) for r in merge.components(spark.createDataFrame(pairs, "lo bigint, hi bigint")).select("old", "rep").collect()]
    assert sorted(got) == [(k, 1) for k in range(1, 82)]


def test_occupancy_is_exact_or_covers_more(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 7, (3, 48, 60))
    for v in rng.integers(0, a.size, 4):
        a.ravel()[v] = 33
    meta = ImageMeta(("z", "y", "x"), a.shape, (3, 24, 20))
    rows = files.from_array(spark, a, "zyx")
    for block, exact in (((1, 6, 5), True), ((2, 17, 13), False)):
        occ = {r["tile_id"] for r in occupancy.tile_occupancy(occupancy.block_max(rows, meta.axes, block), meta, block, 10).filter("occupied").collect()}
        want = {3 * i + j for i in range(2) for j in range(3) if a[:, 24 * i : 24 * i + 24, 20 * j : 20 * j + 20].max() > 10}
        assert occ == want if exact else occ >= want


def test_sampling_stays_within_the_edge_tile(spark):
    a = np.zeros((3, 6, 25), int)
    a[:, :, :20] = 70
    meta = ImageMeta(("z", "y", "x"), a.shape, (3, 6, 10))
    got = {r["tile_id"]: r["occupied"] for r in occupancy.sampled_occupancy(files.from_array(spark, a, "zyx"), meta, (3, 6, 8), 50).collect()}
    assert got == {0: True, 1: True}


def test_otsu_agrees_with_the_kernel(spark):
    v = [1, 2, 2, 3, 50, 51, 52, 52]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "value int")
    assert occupancy.otsu(occupancy.histogram(df)).first()["threshold"] == kernels.otsu(np.array(v)) == 3
    assert occupancy.otsu(occupancy.histogram(df.filter("value = 1"))).first()["threshold"] == 0


def test_histograms_are_bounded(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("value")).unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "value double"))
    bins = occupancy.histogram(df, bins=100)
    assert bins.count() == 100 and bins.agg(F.sum("n")).first()[0] == 5000
    assert abs(occupancy.otsu(bins).first()["threshold"] - 1250) < 30
    wide = spark.createDataFrame([(0,), (1,), (10**9,)], "value bigint")
    assert occupancy.histogram(wide, bins=100).count() == 2


def test_otsu_is_exact_over_any_range(spark):
    rng = np.random.default_rng(2)
    for v in (np.concatenate([rng.integers(0, 10**9, 400), rng.integers(5 * 10**12, 6 * 10**12, 300)]), np.concatenate([rng.normal(0, 1, 500), rng.normal(9, 0.1, 80)])):
        df = spark.createDataFrame(pd.DataFrame({"value": v})).repartition(3)
        assert occupancy.histogram(df).count() == len(np.unique(v))
        assert occupancy.otsu(occupancy.histogram(df)).first()["threshold"] == kernels.otsu(v)


def test_sampled_threshold_is_that_of_the_windows(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 300, (6, 30, 40)) * (rng.random((6, 30, 40)) > 0.7)
    meta = ImageMeta(("z", "y", "x"), a.shape, (4, 16, 16))
    rows = files.from_array(spark, a, "zyx")
    for most in (500, 5):
        parts = [a[tuple(slice(lo, hi) for lo, hi in occupancy.window_box(meta, t, (2, 6, 6)))].ravel() for t in range(min(most, meta.n_tiles))]
        assert occupancy.sampled_threshold(rows, meta, (2, 6, 6), most=most).first()["threshold"] == kernels.otsu(np.concatenate(parts))
    t = occupancy.sampled_threshold(rows, meta, (2, 6, 6)).first()["threshold"]
    got = {r["tile_id"]: r["occupied"] for r in occupancy.sampled_occupancy(rows, meta, (2, 6, 6), None).collect()}
    assert got == {r["tile_id"]: r["vmax"] > t for r in occupancy.sampled_occupancy(rows, meta, (2, 6, 6), None).collect()}


@pytest.mark.parametrize("kind", [int, float])
def test_prepare_keeps_tiles_of_dim_objects_on_a_sparse_image(spark, kind):
    a = np.zeros((64, 64), kind)
    a[4:8, 4:8], a[40:44, 40:44] = 100, 180
    a[5, 5], a[41, 41] = 110, 200
    rows = files.from_array(spark, a, "yx").filter("value <> 0")
    meta = ImageMeta(("y", "x"), a.shape, (32, 32))
    assert sorted(r["tile_id"] for r in workflow.prepare(rows, meta).collect()) == [0, 3]
    got = occupancy.auto_threshold(rows, meta).first()["threshold"]
    assert 0 <= got < 1 and (kind is float or got == kernels.otsu(a))
    # Zeros that are rows count once.
    assert occupancy.auto_threshold(files.from_array(spark, a, "yx"), meta).first()["threshold"] == got
    assert occupancy.auto_threshold(rows, meta, background=False).first()["threshold"] > 100


def test_relations_majority_ties_and_totals(spark):
    a = np.zeros((6, 12), int)
    b = np.zeros((6, 12), int)
    a[:2, :6], a[3:, 2:8], a[:3, 9:] = 7, 4, 90
    b[:, 1:3], b[0:2, 3:5], b[3:5, 4:7] = 31, 30, 32
    df = [files.from_array(spark, m, "yx").withColumnRenamed("value", "label") for m in (a, b)]
    got = {r["a_id"]: (r["match"], r["overlap_voxels"], r["overlap_fraction"]) for r in relations.label_relations(*df, ["y", "x"]).collect()}
    # 7 lies four times in 30 and in 31 each: the lesser one; 4 three times in 31, six times in 32; 90 in none.
    assert got == {7: (30, 4, 0.5), 4: (32, 6, 6 / 9)}
    total = {r["a_id"]: r["overlap_fraction"] for r in relations.label_relations(*df, ["y", "x"], denominator="total").collect()}
    assert total == {7: 4 / 12, 4: 6 / 18}
    rel = relations.label_relations(*df, ["y", "x"])
    assert [r["a_id"] for r in relations.unmatched(relations.label_ids(df[0]), rel).collect()] == [90]
    per_a = {r["a_id"]: r["overlap_voxels"] for r in relations.relations_per_a(relations.label_ids(df[0]), rel).collect()}
    assert per_a == {7: 4, 4: 6, 90: 0}
    per_b = {r["b_id"]: (r["n_a"], r["overlap_voxels"]) for r in relations.relations_per_b(relations.label_ids(df[1]), rel).collect()}
    assert per_b == {30: (1, 4), 31: (0, 0), 32: (1, 6)}
    assert relations.label_relations(df[0], df[1].limit(0), ["y", "x"]).count() == 0


def test_pyramid_is_strided_sampling(spark):
    a = np.arange(3 * 10 * 12).reshape(3, 10, 12) + 1
    rows = pyramid.pyramid(files.from_array(spark, a, "zyx"), "zyx", 3)
    for level in range(3):
        want = a[:, :: 2**level, :: 2**level]
        assert (dense(rows.filter(F.col("level") == level), want.shape, "value") == want).all()
    with pytest.raises(ValueError):
        pyramid.pyramid(rows, "zyx", 0)


def test_growth_and_smoothing_agree_with_the_kernels(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, (9, 11)) * (rng.random((9, 11)) > 0.8)
    a[4, 4] = 3
    rows = files.from_array(spark, a, "yx")
    grown = pyramid.grow(rows.withColumnRenamed("value", "label"), ["y", "x"], a.shape, 2)
    assert (dense(grown, a.shape) == kernels.dilate(a, 2)).all()
    smooth = np.zeros(a.shape)
    for r in pyramid.smooth(rows, ["y", "x"], a.shape, 1.0).collect():
        smooth[r["y"], r["x"]] = r["value"]
    assert np.allclose(smooth, kernels.gaussian(a, 1.0))


def test_kernels():
    a = np.zeros((2, 50, 40), np.float32)
    a[1, 11:20, 25:33] = 1
    out = kernels.dog_label_fn(1, 4, 0.01)(a)
    assert out.max() >= 1 and out[0, 0, 0] == 0 and out.dtype == np.int32
    assert kernels.dilate_labels(fn, 0) is fn
    big = np.arange(5 * 9 * 8).reshape(5, 9, 8)
    assert (kernels.restore_shape(big, (3, 9, 4)) == big[1:4, :, 2:6]).all()
    padded = kernels.restore_shape(big, (5, 13, 7))
    assert padded.shape == (5, 13, 7) and (padded[:, 2:11] == big[:, :, :7]).all() and (padded[:, 0] == padded[:, 2]).all()
    d = np.eye(3, dtype=bool)
    assert kernels.connected_components(d).max() == 3 and kernels.connected_components(d, "full").max() == 1
    assert (kernels.dense_rank(np.array([90, 0, 41, 41, 90, 3000, 0, 12])) == [3, 0, 2, 2, 3, 4, 0, 1]).all()
    assert kernels.threshold_label(np.full((2, 2), 7)).max() == 1
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise MemoryError
        return "ok"

    assert kernels.retry_on_oom(call, sleep=lambda s: None) == "ok" and len(tries) == 3
    with pytest.raises(KeyError):
        kernels.retry_on_oom(lambda: {}["x"], sleep=lambda s: None)


def test_configs_report_all_problems():
    bad = staged.validate_config({"method": "threshold", "settings": {"nope": 1}, "dilate": -1, "other": 0})
    assert len(bad) == 3
    assert staged.validate_config({"method": "magic"}) and staged.validate_config({"method": "custom", "settings": {}})
    custom = lambda **k: staged.validate_config({"method": "custom", "settings": k})
    assert "imported" in custom(module="no.such.module")[0] and "no function" in custom(module="gridweave.operators.kernels", function="nope")[0]
    assert "no keyword 'sigma'" in custom(module="gridweave.operators.kernels", function="dog_label", kwargs={"sigma": 1})[0]
    assert custom(module="gridweave.operators.kernels", function="dog_label", kwargs={"low_sigma": 1}) == []
    f = staged.build_fn({"method": "threshold", "settings": {"threshold": 3}, "dilate": 1})
    assert f(np.pad([[9]], 2)).sum() == 9


def test_halo_rows(spark):
    meta = ImageMeta(("y", "x"), (6, 6), (3, 3), 1)
    rows = grid.assign_halo(spark.createDataFrame([(2, 2), (0, 0)], "y int, x int"), meta)
    assert sorted((r["y"], r["tile_id"], r["is_core"]) for r in rows.collect()) == [(0, 0, True), (2, 0, True), (2, 1, False), (2, 2, False), (2, 3, False)]


def test_chunk_tables_give_the_labels_of_voxel_tables(spark):
    from gridweave.operators import dense as dense_tables

    rng = np.random.default_rng(11)
    a = rng.integers(0, 9, (5, 13, 17)) * (rng.random((5, 13, 17)) > 0.6)
    rows = files.from_array(spark, a, "zyx")
    for halo in (0, (1, 2, 2)):
        meta = ImageMeta(("z", "y", "x"), a.shape, (2, 6, 8), halo)
        want = sorted(tuple(r) for r in staged.stage_tiles(rows, fn, meta).collect())
        chunks = dense_tables.to_chunks(rows, meta)
        assert sorted(tuple(r) for r in dense_tables.stage_chunks(chunks, fn, meta).collect()) == want
    assert dense_tables.stage_chunks(chunks, fn, meta, empty_threshold=99).count() == 0
    assert dense_tables.stage_chunks(chunks.limit(0), fn, meta).count() == 0


def test_models_are_loaded_once_and_again_after_memory_ran_out():
    loads = []

    class Model:
        def __init__(self):
            loads.append(1)

        def eval(self, tile, scale=1, channel_axis=None):
            if len(loads) == 1 and tile.max() == 9:
                raise MemoryError
            assert tile.ndim == 2 + (channel_axis is not None)
            return (tile if channel_axis is None else tile.max(channel_axis)) * scale, "styles"

    f = kernels.model_fn(Model, "m", "eval", do_3d=False, retries=1, backoff=0, scale=2)
    assert (f(np.full((1, 3, 3), 4)) == 8).all() and f(np.ones((1, 3, 3))).shape == (1, 3, 3) and loads == [1]
    assert (f(np.full((1, 3, 3), 9)) == 18).all() and loads == [1, 1]
    with pytest.raises(ValueError, match="planes"):
        f(np.ones((2, 3, 3)))
    g = kernels.model_fn(Model, "m", "eval", do_3d=False, channel_axis=0)
    assert g(np.ones((2, 1, 3, 3))).shape == (1, 3, 3)
    kernels.drop_models()


def test_remapped_ids_are_counted(spark):
    lut = merge.lookup_table(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "lo bigint, hi bigint"))
    assert merge.remap_count(lut).first()["n_remapped"] == 3
    assert merge.remap_count(merge.lookup_table(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "lo bigint, hi bigint"), max_label=3)).first()["n_remapped"] == 2


def test_remapped_ids_are_counted_once_across_partitions(spark, small_partitions):
    pairs = [(1, k) for k in range(2, 82)] + [(2, 81), (3, 81)] + [(k, 5000) for k in range(100, 140)]
    assert merge.remap_count(merge.lookup_table(spark.createDataFrame(pairs, "lo bigint, hi bigint"))).first()["n_remapped"] == 80 + 40


@pytest.mark.parametrize("shape, tile, halo", [((5, 13, 17), (2, 6, 8), (1, 2, 2)), ((1, 20, 9), (1, 7, 4), 2)])
def test_chunk_forms_agree_with_whole_images(spark, shape, tile, halo):
    from gridweave.operators import dense as d

    rng = np.random.default_rng(12)
    a = rng.integers(1, 9, shape) * (rng.random(shape) > 0.5)
    b = rng.integers(1, 5, shape) * (rng.random(shape) > 0.3)
    meta = ImageMeta(("z", "y", "x"), shape, tile, halo)
    ca, cb = (d.to_chunks(files.from_array(spark, m, "zyx"), meta, "int64") for m in (a, b))
    whole = lambda chunks, m=meta, t="int64": dense(d.to_voxels(chunks, m, t), m.shape, "value")
    same_partition(whole(d.tile_process(ca, fn, meta, "int64")), kernels.connected_components(a > 0))
    ids = np.unique(whole(d.tile_process(ca, fn, meta, "int64", sequential_ids=True)))
    assert list(ids) == list(range(len(ids)))
    n = {(r["a_id"], r["b_id"]): r["n"] for r in d.overlap_counts(ca, cb, meta).collect()}
    both = (a > 0) & (b > 0)
    pairs, c = np.unique(np.stack([a[both], b[both]], 1), axis=0, return_counts=True)
    assert n == {tuple(p): k for p, k in zip(pairs.tolist(), c.tolist())}
    bricks = {(r["bz"], r["by"], r["bx"]): r["vmax"] for r in d.block_max(ca, meta, (2, 5, 3), "int64").collect()}
    want = {(r["bz"], r["by"], r["bx"]): r["vmax"] for r in occupancy.block_max(files.from_array(spark, a, "zyx"), "zyx", (2, 5, 3)).collect()}
    assert bricks == want
    assert (whole(d.grow(ca, meta, 2)) == kernels.dilate(a, 2)).all()
    levels = d.pyramid(ca, meta, "int64", 3)
    for i in range(3):
        m = d.level_meta(meta, i)
        assert (whole(levels.filter(F.col("level") == i), m) == a[:, :: 2**i, :: 2**i]).all()
    got = np.zeros(shape)
    for r in d.to_voxels(d.dog(ca, meta, 0.5, 1.0, "int64"), meta, "float64").collect():
        got[r["z"], r["y"], r["x"]] = r["value"]
    assert np.allclose(got, kernels.gaussian(a.astype(float), 0.5) - kernels.gaussian(a.astype(float), 1.0))
    assert d.tile_process(ca.limit(0), fn, meta, "int64").count() == 0
