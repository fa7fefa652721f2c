"""OME-Zarr stores and TIFF planes: round trips, selections, calibration, conversion."""

import json
import struct
import zlib

import numpy as np
import pytest

from gridweave import workflow
from gridweave.meta import ImageMeta
from gridweave.operators import dense
from gridweave.sources import datasource, files, tiff, zarr

META = ImageMeta(("c", "z", "y", "x"), (2, 5, 50, 60), (1, 2, 16, 16), (0,) * 4, {"z": 2.0, "y": 0.5, "x": 0.5})


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(0)
    return (rng.integers(1, 500, META.shape) * (rng.random(META.shape) > 0.7)).astype("uint16")


@pytest.fixture(scope="module")
def chunks(spark, image):
    return dense.to_chunks(files.from_array(spark, image, "czyx"), META)


def whole(df, axes, shape, value="value"):
    pdf = df.toPandas()
    out = np.zeros(shape, "int64")
    out[tuple(pdf[a] for a in axes)] = pdf[value]
    return out


@pytest.mark.parametrize("version, codec, shard", [(2, "gzip", False), (2, None, False), (3, "zstd", False), (3, "gzip", (1, 4, 32, 32))])
def test_round_trip(spark, tmp_path, image, chunks, version, codec, shard):
    path = f"file://{tmp_path}/a.zarr"
    store = zarr.write_zarr(chunks, path, META, n_levels=3, version=version, codec=codec, shard=shard, name="a")
    assert store.axes == META.axes and store.scales[1] == (1.0, 2.0, 1.0, 1.0) and store.units[1] == "micrometer" and store.name == "a"
    for level in range(3):
        want = image[:, :, :: 2**level, :: 2**level]
        assert (whole(zarr.read_zarr(spark, path, level), "czyx", want.shape) == want).all()
    part = image[1, 1:4, 10:30, 20:33]
    got = zarr.read_zarr(spark, path, 0, channel=1, lo=(0, 1, 10, 20), hi=(9, 4, 30, 33)).selectExpr("z - 1 AS z", "y - 10 AS y", "x - 20 AS x", "value")
    assert (whole(got, "zyx", part.shape) == part).all()
    table, meta, dtype = zarr.read_zarr_chunks(spark, path, channel=1)
    assert (whole(dense.to_voxels(table, meta, dtype), "zyx", meta.shape) == image[1]).all() and meta.scale == META.scale
    store = zarr.add_pyramid(spark, path, 4)
    assert len(store.levels) == 4 and (whole(zarr.read_zarr(spark, path, 3), "czyx", (2, 5, 7, 8)) == image[:, :, ::8, ::8]).all()
    for level in (4, -1):
        with pytest.raises(ValueError, match="0 to 3"):
            zarr.read_zarr(spark, path, level)
    with pytest.raises(ValueError, match="channel 2"):
        zarr.read_zarr(spark, path, channel=2)
    with pytest.raises(FileExistsError):
        zarr.write_zarr(chunks, path, META)
    assert files.open_source(spark, path, channel=0).columns == ["z", "y", "x", "value"]


def test_the_data_source(spark, tmp_path, image, chunks, monkeypatch):
    datasource.register(spark)
    for version, shard in ((2, False), (3, (1, 4, 32, 32))):
        path = f"{tmp_path}/{version}.zarr"
        zarr.write_zarr(chunks, f"file://{path}", META, n_levels=2, version=version, shard=shard)
        read = spark.read.format("ome_zarr").option("path", path)
        assert (whole(read.load(), "czyx", image.shape) == image).all()
        assert (whole(read.option("level", 1).load(), "czyx", image[..., ::2, ::2].shape) == image[..., ::2, ::2]).all()
        one = read.option("level", 0).option("channel", 1).load()
        assert one.columns == ["z", "y", "x", "value"] and (whole(one, "zyx", image[1].shape) == image[1]).all()
        monkeypatch.setattr(datasource, "PARTITION_BYTES", 5000)
        parts = datasource._Reader(path, 0, None).partitions()
        assert len(parts) > 2 and len(datasource._Reader(path, 0, 0).partitions()) < len(parts)
        monkeypatch.undo()
    with pytest.raises(Exception, match="level 7"):
        read.option("level", 7).load()


def test_labels_inherit_the_pixel_size_and_are_registered_once(spark, tmp_path, image, chunks):
    for version in (2, 3):
        path = f"file://{tmp_path}/{version}.zarr"
        zarr.write_zarr(chunks, path, META, n_levels=1, version=version)
        meta = ImageMeta(("z", "y", "x"), META.shape[1:], (2, 16, 16))
        labels = dense.to_chunks(files.from_array(spark, image[0], "zyx"), meta, "int64")
        store = zarr.write_zarr_labels(labels, path, meta, "cells", n_levels=2, n_objects=3)
        assert store.scales == ((2.0, 0.5, 0.5), (2.0, 1.0, 1.0))
        zarr.write_zarr_labels(labels, path, meta, "nuclei", n_levels=1)
        zarr.write_zarr_labels(labels, path, meta, "cells", n_levels=1, overwrite=True)
        assert zarr.zarr_label_names(spark, path) == ["cells", "nuclei"]
        assert (whole(zarr.read_zarr(spark, f"{path}/labels/cells"), "zyx", meta.shape) == image[0]).all()
        # Attributes of others stay.
        zarr.write_attributes(spark, path, version, {"omero": {"id": 1}})
        zarr.add_pyramid(spark, path, 2)
        attrs = zarr.open_store(spark, path).attributes
        assert attrs.get("ome", attrs)["omero"] == {"id": 1}


def test_labels_of_a_run_go_into_the_store(spark, tmp_path, image, chunks):
    from functools import partial

    from gridweave.operators import kernels

    path = f"file://{tmp_path}/run.zarr"
    zarr.write_zarr(chunks, path, META, n_levels=1, name="raw")
    meta = zarr.image_meta(spark, path)
    meta = ImageMeta(meta.axes[1:], meta.shape[1:], (3, 20, 20), 2)
    fn = partial(kernels.threshold_label, threshold=300, connectivity="face")
    voxels = files.open_source(spark, path, channel=0)
    labels = workflow.process(voxels, fn, meta, path, "cells", sequential_ids=True, pyramid_levels=2, per_job=4)
    n = kernels.connected_components(image[0] > 300).max()
    got = whole(zarr.read_zarr(spark, f"{path}/labels/cells"), "zyx", meta.shape)
    assert got.max() == n == labels.agg({"label": "max"}).first()[0] and ((got > 0) == (image[0] > 300)).all()
    assert not (tmp_path / "run-stage" / "cells").exists()
    rows = {(r["kind"], r["name"], r["level"]): r["scale"] for r in zarr.zarr_layers(spark, path).collect()}
    assert set(rows) == {("image", "raw", 0), ("labels", "cells", 0), ("labels", "cells", 1)} and rows["labels", "cells", 1] == [2.0, 1.0, 1.0]
    assert workflow.process(voxels, fn, meta).count() == (image[0] > 300).sum()


def test_metadata_that_can_not_be_read_says_so():
    base = {"zarr_format": 2, "shape": [4], "chunks": [2], "dtype": "<u2", "compressor": None, "fill_value": 0, "order": "C", "filters": None}
    info = zarr.parse_array(json.dumps(base))
    assert info.separator == "." and info.key((3,)) == "3" and info.index_of("file:/a/0/3") == (3,)
    for change in ({"fill_value": 7}, {"filters": [{"id": "delta"}]}):
        with pytest.raises(ValueError):
            zarr.parse_array(json.dumps(base | change))
    blosc = zarr.parse_array(json.dumps(base | {"compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError, match="blosc"):
        zarr.decode_chunk(blosc, b"xxxx")
    for info in (zarr.ArrayInfo(3, (9, 9), (2, 2), (4, 4), "<i4", "zstd", "/", "c/", index_checksum=True), zarr.ArrayInfo(2, (9, 9), (4, 4), (4, 4), "<f8", "gzip", "/")):
        assert zarr.parse_array(zarr.array_document(info)[1]) == info
    assert zarr.crc32c(b"123456789") == 0xE3069283
    shard = zarr.encode_shard(info := zarr.ArrayInfo(3, (9, 9), (2, 2), (4, 4), "<u1", None, "/", "c/", index_checksum=True), {(1, 0): bytes([1, 2, 3, 4])})
    assert [(i, a.tolist()) for i, a in zarr.decode_file(info, (2, 1), shard)] == [((5, 2), [[1, 2], [3, 4]])]
    with pytest.raises(ValueError, match="checksum"):
        list(zarr.decode_file(info, (0, 0), shard[:-1] + b"!"))


def test_empty_images(spark, tmp_path):
    path = f"file://{tmp_path}/none.zarr"
    zarr.write_zarr(spark.createDataFrame([], dense.CHUNKS), path, META, n_levels=2)
    assert zarr.read_zarr(spark, path).count() == 0 and zarr.read_zarr_chunks(spark, path, channel=0)[0].count() == 0
    with pytest.raises(ValueError, match="no Zarr group"):
        zarr.open_store(spark, f"file://{tmp_path}/nothing.zarr")


# --- TIFF ------------------------------------------------------------------------


def make_tiff(pages, order="<", compress=False, predictor=False, desc=None, res=None, unit=None, tile=None):
    """A classic TIFF of strips of three rows, or of tiles."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for a in pages:
        h, w = a.shape
        if tile:
            parts = []
            for y in range(0, h, tile[0]):
                for x in range(0, w, tile[1]):
                    t = np.zeros(tile, a.dtype)
                    p = a[y : y + tile[0], x : x + tile[1]]
                    t[: p.shape[0], : p.shape[1]] = p
                    parts.append(t)
        else:
            parts = [a[y : y + 3] for y in range(0, h, 3)]
        offsets, sizes = [], []
        for t in parts:
            t = np.concatenate([t[:, :1], np.diff(t, axis=1)], 1) if predictor else t
            raw = t.astype(t.dtype.newbyteorder(order)).tobytes()
            raw = zlib.compress(raw) if compress else raw
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8]), (259, 3, [8 if compress else 1]), (277, 3, [1]), (339, 3, [kind]), (317, 3, [2 if predictor else 1])]
        tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [3]), (279, 4, sizes)]
        tags += [(270, 2, desc.encode() + b"\0")] if desc else []
        tags += [(282, 5, res), (283, 5, res)] if res else []
        tags += [(296, 3, [unit])] if unit else []
        rows = b""
        for tag, field, v in sorted(tags, key=lambda t: t[0]):
            raw = v if field == 2 else b"".join(struct.pack(order + {3: "H", 4: "I", 5: "I"}[field], x) for x in v)
            n = len(v) // 2 if field == 5 else len(v)
            place = raw.ljust(4, b"\0")
            if len(raw) > 4:
                place = struct.pack(order + "I", len(out))
                out += raw
            rows += struct.pack(order + "HHI", tag, field, n) + place
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + rows
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4"])
@pytest.mark.parametrize("order", ["<", ">"])
def test_planes_are_decoded(dtype, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 200, (10, 13)).astype(dtype) for _ in range(2)]
    for how in ({}, {"compress": True}, {"compress": True, "predictor": dtype != "f4"}, {"tile": (4, 5)}, {"tile": (4, 5), "compress": True}):
        got = [p.pixels() for p in tiff.planes(make_tiff(pages, order, **how))]
        assert len(got) == 2 and all((x == y).all() and x.dtype == np.dtype(dtype) for x, y in zip(pages, got))
    with pytest.raises(ValueError, match="not a TIFF"):
        list(tiff.planes(b"GIF89a  "))


def test_calibration_by_precedence():
    a = [np.zeros((3, 3), "u1")]
    of = lambda **k: tiff.calibration_nm(next(tiff.planes(make_tiff(a, **k))))
    assert of(res=[20_000, 1], unit=3) == {"x": 500, "y": 500} and of(res=[25_400, 2], unit=2) == {"x": 2000, "y": 2000}
    assert of(res=[4, 1], unit=1) == {} and of() == {} and of(res=[0, 1], unit=3) == {}
    assert of(desc="ImageJ=1.5\nunit=micron\nspacing=2\n", res=[4, 1], unit=1) == {"x": 250, "y": 250, "z": 2000}
    ome = '<OME><Pixels PhysicalSizeX="0.1"/></OME>'
    assert of(desc=ome, res=[20_000, 1], unit=3) == {"x": 100, "y": 500}


def test_a_sequence_of_planes_becomes_a_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    volume = rng.integers(0, 3, (2, 3, 7, 8)).astype("u2")
    (tmp_path / "in").mkdir()
    for c in range(2):
        for z in range(3):
            (tmp_path / "in" / f"im_C{c}_Z{z}.tif").write_bytes(make_tiff([volume[c, z]], res=[5000, 1], unit=3))
    (tmp_path / "in" / "note.tif").write_bytes(b"no plane")
    source, pattern = f"file://{tmp_path}/in/*.tif", r"_C(?P<c>\d+)_Z(?P<z>\d+)"
    rows = files.open_source(spark, source, pattern)
    assert rows.columns == ["c", "z", "y", "x", "value"] and (whole(rows, "czyx", volume.shape) == volume).all()
    (tmp_path / "in" / "note.tif").unlink()
    store = workflow.convert(spark, source, f"file://{tmp_path}/out.zarr", pattern, chunks=(1, 1, 4, 4), scale={"z": 1.5}, n_levels=2)
    assert store.scales[0] == (1.0, 1.5, 2.0, 2.0) and (whole(zarr.read_zarr(spark, store.path), "czyx", volume.shape) == volume).all()
    again = workflow.convert(spark, store.path, f"file://{tmp_path}/again.zarr", version=3, shard=True, n_levels=1)
    assert again.scales[0] == (1.0, 1.5, 2.0, 2.0) and (whole(zarr.read_zarr(spark, again.path), "czyx", volume.shape) == volume).all()
    (tmp_path / "in" / "im_C0_Z9.tif").write_bytes(make_tiff([volume[0, 0]] * 2))
    with pytest.raises(Exception, match="has 2 pages"):
        files.open_source(spark, source, pattern).collect()
