"""The operators by name in ``spark.sql``: views of stored datasets, scalar functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .. import planner


class TileBoxes:
    """tile_boxes(shape, tile): one row per tile."""

    def eval(self, shape, tile):
        for n, box in enumerate(planner.tile_boxes(shape, tile)):
            yield n, [lo for lo, _ in box], [hi for _, hi in box]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("tile_boxes", udtf(TileBoxes, returnType="tile_id bigint, lo array<int>, hi array<int>"))
    spark.udf.register("auto_overlap", lambda d, v: list(planner.auto_overlap(d, voxel_size=v)), "array<int>")
    spark.udf.register("read_amplification", lambda n, t: float(planner.read_amplification(n, t)), "double")


def register_views(spark: SparkSession, path: str) -> None:
    """Views ``voxels`` and, where they exist, ``labels`` and ``label_catalog`` of a stored dataset."""
    from ..runtime import exists

    for name, folder in (("voxels", "voxels"), ("labels", "labels"), ("label_catalog", "catalog")):
        if exists(spark, f"{path}/{folder}"):
            spark.read.parquet(f"{path}/{folder}").createOrReplaceTempView(name)
