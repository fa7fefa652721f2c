"""Rasters made of the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import ImageMeta
from ..runtime import table

#: Foreground of the embedding raster: about three tenths of its voxels.
FOREGROUND = 65
TILE_2D, HALO_2D = (32, 16), (2, 2)
TILE_3D, HALO_3D = (3, 64, 64), (1, 4, 4)
TILE_YX = (32, 128)


def emb2d(spark, sf: str) -> DataFrame:
    """y, x, value: position and thousandfold of every embedding component."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("y", "x", F.floor(F.col("v").cast("double") * 1000).cast("int").alias("value"))


def li3d(spark, sf: str) -> DataFrame:
    """z, y, x, value: quantities by line, week and part."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 7).cast("int").alias("y"),
        (F.col("l_partkey") % 256).cast("int").alias("x"),
        "l_quantity",
    )
    return rows.filter("z >= 0 and y >= 0 and x >= 0").groupBy("z", "y", "x").agg(F.sum("l_quantity").cast("int").alias("value"))


def ev_cyx(spark, sf: str) -> DataFrame:
    """c, y, x, value: events by type, user and hour."""
    names = ("click", "error", "purchase", "signup", "view")
    c = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).cast("int") - 1
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    rows = table(spark, sf, "events").select(c.alias("c"), F.col("user_id").cast("int").alias("y"), hour.cast("int").alias("x"))
    return rows.filter("c >= 0 and y >= 0 and x >= 0").groupBy("c", "y", "x").agg(F.count("*").cast("int").alias("value"))


def extent(voxels: DataFrame, axes) -> tuple[int, ...]:
    """One more than the greatest coordinate per axis; an empty image has extent 1."""
    r = voxels.agg(*(F.max(a).alias(a) for a in axes)).first()
    return tuple((r[a] if r[a] is not None else 0) + 1 for a in axes)


def meta2d(spark, sf: str, halo=HALO_2D) -> ImageMeta:
    n = table(spark, sf, "embeddings").agg(F.max("vec_id").alias("n"), F.max(F.size("embedding")).alias("w")).first()
    return ImageMeta(("y", "x"), (int(n["n"]) + 1, int(n["w"])), TILE_2D, halo)


def meta3d(spark, sf: str, halo=HALO_3D) -> ImageMeta:
    return ImageMeta(("z", "y", "x"), extent(li3d(spark, sf), "zyx"), TILE_3D, halo)


SQL_2D = """e AS (SELECT CAST(vec_id AS INTEGER) AS y, CAST(i AS INTEGER) AS x, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS INTEGER) AS value
FROM embeddings, unnest(range(len(embedding))) AS r(i))"""
SQL_3D = """l AS (SELECT * FROM (SELECT CAST(l_linenumber - 1 AS INTEGER) AS z, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7 AS INTEGER) AS y,
CAST(l_partkey % 256 AS INTEGER) AS x, CAST(sum(l_quantity) AS INTEGER) AS value FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY 1, 2, 3) WHERE z >= 0)"""
SQL_CYX = """v AS (SELECT CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS c, CAST(user_id AS INTEGER) AS y,
CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS INTEGER) AS x, CAST(count(*) AS INTEGER) AS value FROM events
WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1, 2, 3)"""
#: Tiles per axis, beside the rasters.
SQL_GRID_2D = "g AS (SELECT max(y) // 32 + 1 AS ny, max(x) // 16 + 1 AS nx, max(y) + 1 AS sy, max(x) + 1 AS sx FROM e)"
SQL_GRID_3D = "g AS (SELECT max(z) // 3 + 1 AS nz, max(y) // 64 + 1 AS ny, max(x) // 64 + 1 AS nx, max(z) + 1 AS sz, max(y) + 1 AS sy, max(x) + 1 AS sx FROM l)"
TILE_ID_2D = "CAST((y // 32) * nx + x // 16 AS BIGINT)"
TILE_ID_3D = "CAST(((z // 3) * ny + y // 64) * nx + x // 64 AS BIGINT)"
