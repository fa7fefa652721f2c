"""Sources, sinks, streaming, SQL functions and whole runs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import workflow
from gridweave.functions import sql
from gridweave.meta import ImageMeta
from gridweave.operators import pyramid
from gridweave.sources import files, sinks
from gridweave.streaming import ingest


def test_image_round_trip_levels_and_channels(spark, tmp_path):
    a = np.arange(2 * 8 * 8).reshape(2, 8, 8) + 1
    path = f"file://{tmp_path}/store"
    rows = files.from_array(spark, a, "cyx")
    sinks.write_image(rows, path, ["c", "y", "x"], n_levels=3)
    assert files.multiscale_levels(spark, path) == [0, 1, 2]
    assert files.read_voxels(spark, path, 1, 1).count() == 16
    plan = files.read_voxels(spark, path, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_image(rows, path, ["c", "y", "x"])
    sinks.add_pyramid(spark, path, ["c", "y", "x"], n_levels=2)
    assert files.read_voxels(spark, path, 0).count() == 128
    with pytest.raises(ValueError):
        files.select_channel(rows.drop("c"), 2)
    assert files.select_channel(rows.drop("c"), 0).count() == 128
    assert files.channel_pair(rows, ["y", "x"], 0, 1).filter("v2 = v1 + 64").count() == 64


def test_labels_catalog_and_layers(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = files.from_array(spark, np.ones((6, 10), int), "yx")
    sinks.write_image(rows, path, ["y", "x"], n_levels=1)
    labels = rows.withColumnRenamed("value", "label")
    sinks.write_labels(labels, path, "cells", ["y", "x"], 2, n_objects=13, sequential=True)
    sinks.write_labels(labels, path, "nuclei", ["y", "x"], 1)
    sinks.register_labels(spark, path, "cells", 13, True)
    with pytest.raises(FileExistsError):
        sinks.write_labels(labels, path, "cells", ["y", "x"])
    assert sorted(tuple(r) for r in files.label_names(spark, path).collect()) == [("cells", 13, True), ("nuclei", None, False)]
    assert files.read_labels(spark, path, "cells", 1).count() == 15
    assert {(r["kind"], r["name"], r["level"]) for r in sinks.layers(spark, path).collect()} == {("image", "image", 0), ("labels", "cells", 0), ("labels", "cells", 1), ("labels", "nuclei", 0)}
    # The pixel size of the image is that of its labels.
    meta = ImageMeta(("y", "x"), (6, 10), (4, 4), 0, {"y": 0.5, "x": 0.25}, "nanometer")
    sinks.write_metadata(spark, path, meta, 2)
    sinks.write_labels(labels, path, "cells", ["y", "x"], 2, n_objects=13, sequential=True, overwrite=True, meta=ImageMeta(("y", "x"), (6, 10), (4, 4), 0, {"x": 3.0}))
    assert sinks.read_scale(spark, path, "labels-cells.json") == ({"y": 0.5, "x": 3.0}, "nanometer")
    with pytest.raises(ValueError, match="level 5"):
        files.read_voxels(spark, path, 5)
    sql.register_views(spark, path)
    assert spark.sql("SELECT count(*) AS n FROM labels WHERE name = 'cells' AND level = 0").first()["n"] == 60


def test_occupancy_is_reused_unless_the_bricks_change(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    a = np.zeros((21, 26), int)
    a[20, 25] = 42
    rows = files.from_array(spark, a, "yx")
    target = sinks.build_occupancy(rows, path, ["y", "x"], (8, 8))
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(2, 3, 42)]
    sinks.build_occupancy(rows.limit(0), path, ["y", "x"], (8, 8))
    assert spark.read.parquet(target).count() == 1
    sinks.build_occupancy(rows, path, ["y", "x"], (4, 5))
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(5, 5, 42)]


def test_manifest_and_markers(spark, tmp_path):
    meta = ImageMeta(("y", "x"), (8, 8), (4, 4), 1)
    path = f"file://{tmp_path}/tiles.json"
    sinks.write_manifest(spark, path, meta, [0, 2, 3], 2, "/t")
    r = files.read_manifest(spark, path).first()
    assert r["batches"] == [[0, 2], [3]] and r["overlap"] == [1, 1] and r["n_tiles"] == 4
    marks = spark.createDataFrame([(0, {0: 3, 2: 1}), (1, {3: 4}), (1, {3: 4})], "batch int, counts map<int,int>")
    assert {x["tile_id"]: x["n"] for x in files.union_counts(marks).collect()} == {0: 3, 2: 1, 3: 4}


def test_batches_resume_where_markers_are_missing(spark, tmp_path):
    from functools import partial

    from gridweave.operators import kernels, merge

    rng = np.random.default_rng(7)
    a = (rng.random((12, 20)) > 0.6).astype(int)
    meta = ImageMeta(("y", "x"), a.shape, (4, 5), 1)
    rows, fn = files.from_array(spark, a, "yx"), partial(kernels.threshold_label, threshold=0, connectivity="face")
    base = f"file://{tmp_path}/stage"
    plan = workflow.prepare(rows, meta, per_job=3, skip_empty=False).cache()
    assert workflow.segment_batches(rows, fn, meta, plan.filter("batch_id = 1"), base) == 1
    assert workflow.segment_batches(rows, fn, meta, plan, base, wave=2) == 3
    assert workflow.segment_batches(rows, fn, meta, plan, base) == 0
    counts = {r["tile_id"]: r["n"] for r in files.read_counts(spark, f"{base}/counts").collect()}
    assert set(counts) == set(range(12))
    got = workflow.merge_batches(spark, meta, base).toPandas()
    want = merge.tile_process(rows, fn, meta, sequential_ids=True).toPandas()
    key = ["y", "x"]
    assert got.sort_values(key).label.tolist() == want.sort_values(key).label.tolist()
    assert workflow.merge_batches(spark, meta, f"file://{tmp_path}/none").count() == 0


def test_stages_and_leading_axes(spark, tmp_path):
    meta = ImageMeta(("y", "x"), (8, 8), (4, 4))
    sinks.create_stage(spark, f"file://{tmp_path}/s", meta)
    assert spark.read.parquet(f"file://{tmp_path}/s/staged").columns == ["tile_id", "y", "x", "local"]
    with pytest.raises(FileExistsError):
        sinks.create_stage(spark, f"file://{tmp_path}/s", meta)
    assert files.leading_index("tczyx", 3) == {"t": 0, "c": 3} and files.leading_index("yx") == {}
    rows = files.from_array(spark, np.arange(1, 17).reshape(2, 2, 2, 2), "tcyx")
    assert sorted(r["value"] for r in files.select_leading(rows, 1).collect()) == [5, 6, 7, 8]
    assert workflow.fetch_model(dict) == "dict"
    sinks.write_image(rows.filter("t = 0").drop("t", "c").dropDuplicates(["y", "x"]), f"file://{tmp_path}/i", ["y", "x"], 1)
    assert spark.read.parquet(workflow.occupancy_job(spark, f"file://{tmp_path}/i", (8, 8))).count() == 1


def test_file_sequence(spark, tmp_path):
    names = spark.createDataFrame([(f"sample_Z{z}_C{c}_T0.tif",) for z in range(3) for c in range(2)] + [("notes.txt",), (None,)], "name string")
    rows = files.sequence_axes(names, r"_Z(?P<z>\d+)_C(?P<c>\d+)_T(?P<t>\d+)")
    assert rows.columns == ["name", "c", "z"] and rows.count() == 6
    with pytest.raises(ValueError):
        files.sequence_axes(names, r"_Z(\d+)")
    with pytest.raises(ValueError, match="sequence_pattern"):
        files.open_source(spark, "/some/*.tif")
    for z in range(2):
        (tmp_path / f"p_Z{z}.bin").write_bytes(bytes([z]))
    got = files.open_source(spark, f"file://{tmp_path}/*.bin", r"_Z(?P<z>\d+)")
    assert sorted((r["z"], bytes(r["content"])) for r in got.collect()) == [(0, b"\0"), (1, b"\1")]
    with pytest.raises(NotImplementedError, match="h5py"):
        files.open_source(spark, "x.ims")


def test_metadata_documents(spark):
    meta = pyramid.pyramid_meta(spark, (4, 6, 10), "zyx", {"z": 3.0, "y": 0.25, "x": 0.75}, 3)
    assert [r["scale"] for r in meta.filter("axis = 'y'").orderBy("level").collect()] == [0.25, 0.5, 1.0]
    for version in ("0.4", "0.5"):
        doc = pyramid.ngff_attributes(meta, "image", version).withColumnRenamed("attributes", "attrs")
        got = {r["axis"]: (r["scale"], r["unit"]) for r in files.ngff_pixel_size(doc).collect()}
        assert got == {"z": (3.0, "micrometer"), "y": (0.25, "micrometer"), "x": (0.75, "micrometer")}
    dirty = spark.createDataFrame([(None,), ("",), ("{",), ("[]",), ('{"multiscales": 3}',), ('{"multiscales": []}',)], "attrs string")
    assert files.ngff_pixel_size(dirty).count() == 0


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([(i % 2, i, 1, t0 + dt.timedelta(minutes=20 * i), t0) for i in range(6)], "run_id bigint, tile_id bigint, n bigint, updated_at timestamp_ntz, arrived_at timestamp_ntz")
    src = f"file://{tmp_path}/in"
    rows.unionByName(rows).write.parquet(src)
    stream = ingest.read_stream(spark, src, rows.schema)
    for _ in range(2):
        ingest.append_staged(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert ingest.newest_counts(spark.read.parquet(f"file://{tmp_path}/out")).count() == 6
    q = ingest.arrivals(stream, "updated_at", "run_id").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 12
    q = ingest.sessions(stream, "updated_at", "run_id", "50 minutes").writeStream.outputMode("complete").format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("s").count() == 2


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT * FROM tile_boxes(array(4, 5), array(2, 2))").count() == 6
    assert spark.sql("SELECT auto_overlap(30D, array(2D, 0.1D, 0.1D)) AS o").first()["o"] == [2, 30, 30]


def test_whole_runs_and_relations(spark, tmp_path):
    a = np.zeros((16, 32), int)
    a[4:12, 8:24] = 500
    a[1:3, 1:4] = 50
    meta = ImageMeta(("y", "x"), a.shape, (16, 16), 4)
    rows = files.from_array(spark, a, "yx")
    plan = workflow.prepare(rows, meta, per_job=1, threshold=600)
    assert plan.count() == 0 and workflow.prepare(rows, meta, per_job=1, threshold=0).count() == 2
    from functools import partial

    from gridweave.operators import kernels

    fn = partial(kernels.threshold_label, threshold=0)
    plan = workflow.prepare(rows, meta, per_job=1, threshold=0)
    assert workflow.segment(rows, fn, meta, plan).count() == int((a > 0).sum())
    assert workflow.segment(rows, fn, meta, plan.filter("batch_id = 1")).select("tile_id").distinct().count() == 1
    path = f"file://{tmp_path}/store"
    configs = {"all": {"settings": {"threshold": 0}}, "bright": {"settings": {"threshold": 100}}}
    workflow.run(rows, {"method": "threshold", "settings": {"threshold": 0}}, meta, path, "kept", keep_stage=True, skip_empty=True, threshold=0)
    assert files.read_counts(spark, f"{path}-stage/kept/counts").count() == 2
    out = workflow.run_many(rows, configs, meta, path, [("all", "bright")], {"method": "threshold"})
    per_a, per_b = out["all", "bright"]
    assert sorted((r["a_id"], r["match"], r["overlap_voxels"]) for r in per_a.collect()) == [(1, None, 0), (2, 1, 128)]
    assert [tuple(r) for r in per_b.collect()] == [(1, 1, 128)]
    assert spark.read.option("header", True).csv(f"{path}/relations/all-bright/per_a").count() == 2
    with pytest.raises(ValueError, match="nope.*unknown segmentation|unknown method"):
        workflow.run_many(rows, {"x": {"method": "nope"}}, meta, path, [("x", "y")])
