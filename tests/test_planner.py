"""Planning functions: what they must hold for any shape, and a few values worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave import planner as p
from gridweave.meta import ImageMeta

shapes = st.lists(st.integers(1, 40), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(shapes, st.data())
def test_tiles_cover_an_image_exactly_in_row_major_order(shape, data):
    tile = [data.draw(st.integers(1, 50)) for _ in shape]
    if math.prod(-(-s // t) for s, t in zip(shape, tile)) > 4000:
        return
    hits = np.zeros(shape, int)
    starts = []
    for n, box in enumerate(p.tile_boxes(shape, tile)):
        assert list(box) == p.tile_box(shape, tile, n)
        hits[tuple(slice(lo, hi) for lo, hi in box)] += 1
        starts.append(tuple(lo for lo, _ in box))
        assert all(hi - lo == min(t, s - lo) for (lo, hi), t, s in zip(box, tile, shape))
    assert (hits == 1).all() and starts == sorted(starts)
    meta = ImageMeta(tuple("tczyx"[-len(shape) :]), tuple(shape), tuple(tile))
    assert meta.n_tiles == len(starts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.lists(st.integers(1, 90), min_size=1, max_size=4))
def test_one_number_is_the_halo_of_every_axis_but_the_thin_ones(width, tile):
    got = p.normalize_overlap(width, len(tile), tile)
    assert got == p.normalize_overlap([width] * len(tile), len(tile), tile) == tuple(width if t > 1 else 0 for t in tile)
    assert p.normalize_overlap(width, len(tile)) == (width,) * len(tile)


@pytest.mark.parametrize("bad", [[5], [5, 5, 5], [5, -2]])
def test_halos_of_a_wrong_form(bad):
    with pytest.raises(ValueError):
        p.normalize_overlap(bad, 2)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 80), st.floats(1, 3), st.lists(st.floats(0.05, 4), min_size=2, max_size=3))
def test_a_halo_by_size_covers_the_object_on_every_axis(diameter, safety, voxel):
    per_axis = p.auto_overlap(diameter, safety, voxel)
    length = diameter * safety * voxel[-1]
    assert all(h * v >= length * (1 - 1e-9) and (h == 1 or (h - 1) * v < length * (1 + 1e-9)) for h, v in zip(per_axis, voxel))
    assert p.auto_overlap(diameter, safety) == per_axis[-1]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 2000), st.floats(0, 1))
def test_output_chunks_divide_the_tile_or_are_the_tile(chunk, cap, fraction):
    (got,) = p.capped_output_chunks((chunk,), (cap,), fraction)
    assert chunk % got == 0
    if got == chunk:
        better = [d for d in range(1, min(cap, chunk) + 1) if chunk % d == 0 and d >= max(1, int(cap * fraction))]
        assert chunk <= cap or not better
    else:
        assert got <= cap < chunk and not any(chunk % d == 0 for d in range(got + 1, min(cap, chunk) + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=5, max_size=5), st.lists(st.integers(1, 3000), min_size=5, max_size=5))
def test_chunks_stay_within_image_source_and_caps(shape, source):
    for given_, limit in ((None, shape), (source, source)):
        got = p.default_chunks(shape, "tczyx", given_)
        assert all(1 <= c <= min(s, lim, p.CHUNK_CAP[a]) for c, s, lim, a in zip(got, shape, limit, "tczyx"))
    level = [-(-s // k) for s, k in zip(shape, p.strides("tczyx", 3))]
    got = p.level_chunks(source, p.strides("tczyx", 3), "tczyx", level)
    assert all(1 <= c <= s for c, s in zip(got, level))
    assert all(c == s or c >= p.CHUNK_FLOOR[a] for c, s, a in zip(got[-2:], level[-2:], "yx"))
    assert all(c <= max(p.CHUNK_CAP[a], p.CHUNK_FLOOR.get(a, 1)) for c, a in zip(got, "tczyx"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 600), min_size=2, max_size=4), st.lists(st.integers(1, 30000), min_size=4, max_size=4), st.sampled_from([1, 2, 4, 8]))
def test_shards_are_whole_multiples_of_chunks_within_the_padded_image(chunks, shape, item):
    shape = shape[: len(chunks)]
    chunks = [min(c, s) for c, s in zip(chunks, shape)]
    for shard in (p.auto_shard(chunks, shape, item), p.fit_shard([7 * c + 1 for c in chunks], chunks, shape)):
        assert all(w % c == 0 and c <= w <= -(-s // c) * c for w, c, s in zip(shard, chunks, shape))
    assert math.prod(p.auto_shard(chunks, shape, item)) * item <= max(p.SHARD_BYTES, math.prod(chunks) * item)


def test_many_files_bring_a_warning_unless_they_are_shards():
    shape, chunks = (3, 300, 20_000, 20_000), (1, 1, 512, 512)
    with pytest.warns(UserWarning):
        n = p.chunk_count(shape, chunks)
    assert n == 3 * 300 * 40 * 40 == p.chunk_count(shape, chunks, sharded=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=4))
def test_bricks_fit_four_times_into_a_tile(tile):
    block = p.block_for_tile(tile)
    assert all(1 <= b and (b == 1 or 4 * b <= t) for b, t in zip(block, tile)) and all(b <= 128 for b in block) and all(b == 1 for b in block[:-2])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=4), st.integers(1, 10**7))
def test_a_filled_box_is_the_largest_of_its_kind(shape, voxels):
    box = p.fill_box(shape, voxels)
    side = max(box)
    assert all(b == min(s, side) for b, s in zip(box, shape))
    assert math.prod(box) <= voxels or side == 1
    assert list(box) == shape or math.prod(min(s, side + 1) for s in shape) > voxels


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=5), st.integers(1, 4), st.integers(1, 6), st.integers(1, 1 << 38))
def test_tiles_keep_to_the_budget(shape, channels, workers, memory):
    tile = p.auto_tile_shape(shape, 2, available_memory=memory, n_workers=workers, n_channels=channels)
    assert len(tile) == len(shape) and all(1 <= t <= s for t, s in zip(tile, shape)) and all(t == 1 for t in tile[:-3])
    assert math.prod(tile) * 2 * channels <= max(p.LEAST_TILE_BYTES, min(p.TILE_BYTES, memory // workers // 4))
    assert math.prod(p.auto_tile_shape(shape, 2, gpu_memory=memory, available_memory=memory)) * 2 <= max(p.LEAST_TILE_BYTES, min(2 * p.TILE_BYTES, memory // 2))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=2, max_size=5), st.floats(1, 60), st.booleans())
def test_model_tiles_are_planes_or_span_all_of_z(shape, diameter, solid):
    tile = p.auto_tile_shape_model(shape, 2, diameter, solid, available_memory=16 << 30, n_workers=2)
    assert len(tile) == len(shape) and all(t <= s for t, s in zip(tile, shape))
    if len(shape) > 2:
        assert tile[-3] == (shape[-3] if solid else 1) and all(t == 1 for t in tile[:-3])
    assert all(t == s or t >= int(4 * diameter) for t, s in zip(tile[-2:], shape[-2:]))


@pytest.mark.parametrize("f", [p.auto_tile_shape, p.auto_tile_shape_model])
def test_an_image_has_a_channel(f):
    with pytest.raises(ValueError):
        f((30, 30), 1, n_channels=0)


def test_amplification_by_hand():
    assert p.read_amplification((2, 10), (4, 25)) == (4 * 30) / (4 * 25)
    assert p.halo_amplification((10, 20), (1, 5), (1000, 25)) == (12 * 25) / (10 * 20)
    with pytest.raises(ValueError):
        p.halo_amplification((5, 40), (5, 0), (90, 90))


def test_workers_leave_a_cpu_and_keep_to_the_memory(monkeypatch):
    monkeypatch.setenv("SLURM_CPUS_PER_TASK", "9")
    monkeypatch.setenv("SLURM_MEM_PER_NODE", "100")
    assert p.cpu_allocation() == 9 and p.memory_allocation() == 100 * p.MIB
    assert p.safe_worker_count(1) == 8 and p.safe_worker_count(5 * p.MIB) == 4 and p.safe_worker_count(1 << 40) == 1
    assert p.safe_worker_count(1, use_gpu=True) == 1


def test_batches_windows_and_paths():
    assert p.batches(list(range(7)), 3) == [[0, 1, 2], [3, 4, 5], [6]]
    with pytest.raises(ValueError):
        p.batches([1], 0)
    for size in (1, 40, 64, 65, 300):
        windows = p.sampling_windows(size)
        assert len(windows) == 3 and all(0 <= lo < hi <= size and hi - lo == min(size, 64) for lo, hi in windows) and windows == sorted(windows)
    assert p.occupancy_path("/data/brain.zarr/", 2).startswith("/data/brain.occupancy") and p.occupancy_path("/x.ome.zarr") == p.occupancy_path("/x.zarr")
