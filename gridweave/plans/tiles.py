"""Queries of the tiled array engine, one or more per operator, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import planner
from ..meta import ImageMeta
from ..operators import dense, grid, kernels, merge, occupancy, pyramid, relations, staged
from ..runtime import materialize, shared_dir, table
from ..sources import files, sinks
from . import rasters
from .rasters import FOREGROUND, SQL_2D, SQL_3D, SQL_CYX, SQL_GRID_2D, SQL_GRID_3D, TILE_ID_2D, TILE_ID_3D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _face_fn(tile: np.ndarray) -> np.ndarray:
    return kernels.connected_components(tile > FOREGROUND)


def _solid_fn(tile: np.ndarray) -> np.ndarray:
    return kernels.connected_components(tile > 0)


# --- sources and projections ---------------------------------------------------


@query(f"WITH {SQL_3D} SELECT z, y, x, value FROM l")
def voxel_scan(spark, sf):
    return rasters.li3d(spark, sf)


@query(f"WITH {SQL_CYX} SELECT y, x, value FROM v WHERE c = 2")
def channel_select(spark, sf):
    return files.select_channel(rasters.ev_cyx(spark, sf), 2)


@query(f"WITH {SQL_CYX} SELECT y, x, coalesce(max(value) FILTER (c = 0), 0) AS v1, coalesce(max(value) FILTER (c = 4), 0) AS v2 FROM v WHERE c IN (0, 4) GROUP BY y, x")
def channel_pair(spark, sf):
    return files.channel_pair(rasters.ev_cyx(spark, sf), ["y", "x"], 0, 4)


@query(f"WITH {SQL_CYX} SELECT DISTINCT printf('sample_Z%04d_C%d_T0.tif', y, c) AS name, c, y AS z FROM v")
def file_sequence_axes(spark, sf):
    names = rasters.ev_cyx(spark, sf).select(F.format_string("sample_Z%04d_C%d_T0.tif", "y", "c").alias("name")).distinct()
    return files.sequence_axes(names, r"sample_Z(?P<z>\d+)_C(?P<c>\d+)_T(?P<t>\d+)")


@query(
    """WITH d AS (SELECT DISTINCT record_id, attrs FROM store_attrs WHERE attrs IS NOT NULL AND json_valid(attrs)),
m AS (SELECT record_id, coalesce(json_extract(attrs, '$.multiscales'), json_extract(attrs, '$.ome.multiscales')) -> '$[0]' AS m FROM d),
s AS (SELECT record_id, m -> '$.axes' AS axes, list_filter(CAST(m -> '$.datasets[0].coordinateTransformations' AS JSON[]), lambda t: t ->> '$.type' = 'scale')[1] -> '$.scale' AS scale FROM m),
a AS (SELECT record_id, unnest(CAST(axes AS JSON[])) AS axis, unnest(CAST(scale AS JSON[])) AS scale FROM s WHERE json_type(axes) = 'ARRAY' AND json_type(scale) = 'ARRAY'
  AND len(list_filter(CAST(scale AS JSON[]), lambda x: json_type(x) = 'VARCHAR')) = 0)
SELECT DISTINCT record_id, axis ->> '$.name' AS axis, CAST(scale AS DOUBLE) AS scale, axis ->> '$.unit' AS unit, true AS calibrated FROM a WHERE json_type(axis) = 'OBJECT' AND axis ->> '$.name' IN ('z', 'y', 'x') AND scale IS NOT NULL"""
)
def ngff_calibration(spark, sf):
    return files.ngff_pixel_size(table(spark, sf, "store_attrs").filter("attrs is not null"), "attrs", ["record_id"]).distinct()


@query(f"WITH {SQL_3D} SELECT z, y, x, value FROM l WHERE z >= 1 AND z < 3 AND y >= 60 AND y < 200 AND x >= 10 AND x < 100")
def region_slice(spark, sf):
    return grid.region(rasters.li3d(spark, sf), rasters.meta3d(spark, sf), (1, 60, 10), (3, 200, 100))


@query(f"WITH {SQL_2D} SELECT y, x, value FROM e WHERE value > {FOREGROUND}")
def threshold_mask(spark, sf):
    return rasters.emb2d(spark, sf).filter(F.col("value") > FOREGROUND)


# --- tiles and halos -----------------------------------------------------------


@query(
    f"""WITH {SQL_3D}, {SQL_GRID_3D}
SELECT CAST((tz * ny + ty) * nx + tx AS BIGINT) AS tile_id, CAST(tz AS INTEGER) AS tz, CAST(tz * 3 AS INTEGER) AS z_lo, CAST(least(tz * 3 + 3, sz) AS INTEGER) AS z_hi,
CAST(ty AS INTEGER) AS ty, CAST(ty * 64 AS INTEGER) AS y_lo, CAST(least(ty * 64 + 64, sy) AS INTEGER) AS y_hi,
CAST(tx AS INTEGER) AS tx, CAST(tx * 64 AS INTEGER) AS x_lo, CAST(least(tx * 64 + 64, sx) AS INTEGER) AS x_hi
FROM g, unnest(range(nz)) a(tz), unnest(range(ny)) b(ty), unnest(range(nx)) c(tx)"""
)
def tile_grid(spark, sf):
    return grid.tile_grid(spark, rasters.meta3d(spark, sf))


@query(f"WITH {SQL_3D}, {SQL_GRID_3D} SELECT z, y, x, value, {TILE_ID_3D} AS tile_id FROM l, g")
def tile_assign(spark, sf):
    return grid.assign_tiles(rasters.li3d(spark, sf), rasters.meta3d(spark, sf))


@query(
    f"""WITH {SQL_2D}, {SQL_GRID_2D}
SELECT y, x, value, CAST(ty * nx + tx AS BIGINT) AS tile_id, ty = y // 32 AND tx = x // 16 AS is_core
FROM e, g, unnest(range(greatest(y - 2, 0) // 32, least(y + 2, sy - 1) // 32 + 1)) a(ty), unnest(range(greatest(x - 2, 0) // 16, least(x + 2, sx - 1) // 16 + 1)) b(tx)"""
)
def halo_assign(spark, sf):
    return grid.assign_halo(rasters.emb2d(spark, sf), rasters.meta2d(spark, sf))


_PLANS = [((16, 1024, 1024), (4, 30, 30), (120, 37888, 27392)), ((1, 8000, 8000), (0, 30, 30), (1, 45961, 42072)), ((16, 1024, 1024), (30, 30, 30), (120, 37888, 27392))]


@query(
    "SELECT CAST(n AS INTEGER) AS n, CASE WHEN a > ha AND b > hb AND c > hc THEN CAST(least(a + 2 * ha, sa) AS DOUBLE) * least(b + 2 * hb, sb) * least(c + 2 * hc, sc) / (CAST(a AS DOUBLE) * b * c) END AS amplification FROM (VALUES "
    + ", ".join(f"({i}, {', '.join(map(str, (*t, *h, *s)))})" for i, (t, h, s) in enumerate(_PLANS))
    + ") AS t(n, a, b, c, ha, hb, hc, sa, sb, sc)"
)
def halo_amplification(spark, sf):
    """Of each plan; null where the halo is as wide as the tile, which is an error of the planner."""

    def of(plan):
        try:
            return planner.halo_amplification(*plan)
        except ValueError:
            return None

    return spark.createDataFrame([(i, of(p)) for i, p in enumerate(_PLANS)], "n int, amplification double")


_READS = [((1, 1024, 1024), (16, 1500, 1500)), ((16, 512, 512), (16, 1024, 1024)), ((1, 4096, 4096), (8, 100, 100))]


@query(
    "SELECT CAST(n AS INTEGER) AS n, ceil(ta / CAST(na AS DOUBLE)) * na * ceil(tb / CAST(nb AS DOUBLE)) * nb * ceil(tc / CAST(nc AS DOUBLE)) * nc / (CAST(ta AS DOUBLE) * tb * tc) AS amplification FROM (VALUES "
    + ", ".join(f"({i}, {', '.join(map(str, (*n, *t)))})" for i, (n, t) in enumerate(_READS))
    + ") AS t(n, na, nb, nc, ta, tb, tc)"
)
def read_amplification(spark, sf):
    return spark.createDataFrame([(i, planner.read_amplification(n, t)) for i, (n, t) in enumerate(_READS)], "n int, amplification double")


_OVERLAPS = [(30.0, (1.0, 1.0, 1.0)), (30.0, (2.0, 0.1, 0.1)), (15.0, (2.0, 0.1, 0.1)), (12.5, (0.5, 0.25, 0.25))]


@query(
    "SELECT CAST(n AS INTEGER) AS n, [CAST(greatest(1, ceil(d * vc / va)) AS INTEGER), CAST(greatest(1, ceil(d * vc / vb)) AS INTEGER), CAST(greatest(1, ceil(d * vc / vc)) AS INTEGER)] AS overlap FROM (VALUES "
    + ", ".join(f"({i}, {d}::DOUBLE, {', '.join(f'{x}::DOUBLE' for x in v)})" for i, (d, v) in enumerate(_OVERLAPS))
    + ") AS t(n, d, va, vb, vc)"
)
def auto_overlap(spark, sf):
    return spark.createDataFrame([(i, list(planner.auto_overlap(d, voxel_size=v))) for i, (d, v) in enumerate(_OVERLAPS)], "n int, overlap array<int>")


_SHAPES = [((128, 2048, 2048), 2), ((4000, 3000, 3000), 2), ((60, 9000, 9000), 4), ((20000, 30000), 1)]


@query(
    """WITH s(n, z, y, x, item, d) AS (VALUES (0, 128, 2048, 2048, 2, 3), (1, 4000, 3000, 3000, 2, 3), (2, 60, 9000, 9000, 4, 3), (3, 1, 20000, 30000, 1, 2)),
b AS (SELECT *, 67108864.0::DOUBLE / item AS vox FROM s), c AS (SELECT *, floor(pow(vox, 1.0 / d)) AS side FROM b),
f AS (SELECT *, (CASE WHEN d = 3 AND z <= side THEN z ELSE 1 END) * (CASE WHEN y <= side THEN y ELSE 1 END) * (CASE WHEN x <= side THEN x ELSE 1 END) AS thin,
  d - (CASE WHEN d = 3 AND z <= side THEN 1 ELSE 0 END) - (CASE WHEN y <= side THEN 1 ELSE 0 END) - (CASE WHEN x <= side THEN 1 ELSE 0 END) AS free FROM c),
h AS (SELECT *, CASE WHEN free = 0 OR free = d THEN side ELSE floor(pow(vox / thin, 1.0 / free)) END AS wide FROM f)
SELECT n, CASE WHEN d = 3 THEN [CAST(least(z, CASE WHEN z <= side THEN z ELSE wide END) AS INTEGER), CAST(least(y, wide) AS INTEGER), CAST(least(x, wide) AS INTEGER)]
ELSE [CAST(least(y, wide) AS INTEGER), CAST(least(x, wide) AS INTEGER)] END AS tile FROM h"""
)
def auto_tile_shape(spark, sf):
    rows = [(i, list(planner.auto_tile_shape(s, k, available_memory=64 << 30, n_workers=4))) for i, (s, k) in enumerate(_SHAPES)]
    return spark.createDataFrame(rows, "n int, tile array<int>")


_CHUNKS = [(2048, 1024), (1500, 1024), (1031, 1024), (1093, 1024), (16, 1024), (6000, 1024)]


@query(
    "WITH c(n, c, cap) AS (VALUES " + ", ".join(f"({i}, {c}, {k})" for i, (c, k) in enumerate(_CHUNKS)) + "), "
    "d AS (SELECT n, c, cap, max(k) FILTER (c % k = 0) AS best FROM c, unnest(range(1, 1025)) AS r(k) WHERE k <= cap GROUP BY ALL) "
    "SELECT n, CAST(CASE WHEN c <= cap OR best < cap // 4 THEN c ELSE best END AS INTEGER) AS chunk FROM d"
)
def chunk_plan(spark, sf):
    return spark.createDataFrame([(i, planner.capped_output_chunks((c,), (k,))[0]) for i, (c, k) in enumerate(_CHUNKS)], "n int, chunk int")


@query(f"WITH {SQL_3D}, {SQL_GRID_3D}, t AS (SELECT DISTINCT {TILE_ID_3D} AS tile_id FROM l, g) SELECT tile_id, CAST((row_number() OVER (ORDER BY tile_id) - 1) // 8 AS BIGINT) AS batch_id FROM t")
def tile_batches(spark, sf):
    tiles = grid.assign_tiles(rasters.li3d(spark, sf), rasters.meta3d(spark, sf)).select("tile_id").distinct()
    return staged.batches_of(tiles, 8)


# --- occupancy -----------------------------------------------------------------

_BLOCK = (1, 16, 16)
_OCC = 100


@query(f"WITH {SQL_CYX} SELECT c, CAST(y // 8 AS INTEGER) AS by, CAST(x // 64 AS INTEGER) AS bx, max(value) AS vmax FROM v GROUP BY 1, 2, 3")
def block_max(spark, sf):
    return occupancy.block_max(rasters.ev_cyx(spark, sf), ["y", "x"], (8, 64), keep=["c"])


_SQL_OCC = f"{SQL_3D}, {SQL_GRID_3D}, o AS (SELECT {TILE_ID_3D} AS tile_id, max(value) AS vmax, max(value) > {_OCC} AS occupied FROM l, g GROUP BY 1)"


def _occupancy(spark, sf):
    meta = rasters.meta3d(spark, sf)
    return meta, occupancy.tile_occupancy(occupancy.block_max(rasters.li3d(spark, sf), meta.axes, _BLOCK), meta, _BLOCK, _OCC)


@query(f"WITH {_SQL_OCC} SELECT * FROM o")
def tile_occupancy_exact(spark, sf):
    return _occupancy(spark, sf)[1]


@query(
    f"""WITH {SQL_3D}, {SQL_GRID_3D}, b AS (SELECT *, (z // 3) * 3 AS lz, (y // 64) * 64 AS ly, (x // 64) * 64 AS lx FROM l, g),
h AS (SELECT *, least(lz + 3, sz) AS hz, least(ly + 64, sy) AS hy, least(lx + 64, sx) AS hx FROM b),
s AS (SELECT *, greatest(lz, least(lz + CAST(floor((hz - lz - 2) / 2.0) AS INTEGER), hz - 2)) AS az, greatest(ly, least(ly + CAST(floor((hy - ly - 32) / 2.0) AS INTEGER), hy - 32)) AS ay,
  greatest(lx, least(lx + CAST(floor((hx - lx - 32) / 2.0) AS INTEGER), hx - 32)) AS ax FROM h)
SELECT {TILE_ID_3D} AS tile_id, max(value) AS vmax, max(value) > {_OCC} AS occupied FROM s
WHERE z >= az AND z < least(az + 2, hz) AND y >= ay AND y < least(ay + 32, hy) AND x >= ax AND x < least(ax + 32, hx) GROUP BY 1"""
)
def tile_occupancy_sampled(spark, sf):
    return occupancy.sampled_occupancy(rasters.li3d(spark, sf), rasters.meta3d(spark, sf), (2, 32, 32), _OCC)


@query(f"WITH {_SQL_OCC} SELECT CAST({_OCC} AS DOUBLE) AS threshold, (SELECT CAST(nz * ny * nx AS BIGINT) FROM g) AS n_tiles, count(*) FILTER (occupied) AS n_occupied, CAST(1 - count(*) FILTER (occupied) / CAST((SELECT nz * ny * nx FROM g) AS DOUBLE) AS DOUBLE) AS empty_fraction FROM o")
def occupancy_summary(spark, sf):
    meta, occ = _occupancy(spark, sf)
    return occupancy.occupancy_summary(occ, meta.n_tiles, _OCC)


_SQL_OTSU = """h AS (SELECT CAST(value AS DOUBLE) AS v, count(*) AS n FROM {src} GROUP BY 1),
k AS (SELECT v, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS w0, CAST(sum(v * n) OVER (ORDER BY v) AS DOUBLE) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(v * n) OVER () AS DOUBLE) AS s FROM h),
m AS (SELECT v, w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) AS var FROM k WHERE w0 < w)
SELECT coalesce(first(v ORDER BY var DESC, v), 0.0) AS threshold FROM m"""


@query(f"WITH {SQL_2D}, " + _SQL_OTSU.format(src="e"))
def otsu_threshold(spark, sf):
    return occupancy.otsu(occupancy.histogram(rasters.emb2d(spark, sf)))


def _sql_window(f: float) -> str:
    low = "greatest(0, least(CAST(floor(s{a} * {f}) AS INTEGER) - least(s{a}, 64) // 2, s{a} - least(s{a}, 64)))"
    return " AND ".join(f"{a} >= {low.format(a=a, f=f)} AND {a} < {low.format(a=a, f=f)} + least(s{a}, 64)" for a in "zyx")


# A voxel in several windows counts once for each.
_SQL_SAMPLE = " UNION ALL ".join(f"SELECT value FROM l, g WHERE {_sql_window(f)}" for f in (0.33, 0.5, 0.66))


@query(f"WITH {SQL_3D}, {SQL_GRID_3D}, q AS ({_SQL_SAMPLE}), " + _SQL_OTSU.format(src="q"))
def auto_threshold(spark, sf):
    # Its SQL counts the present voxels alone.
    return occupancy.auto_threshold(rasters.li3d(spark, sf), rasters.meta3d(spark, sf), background=False)


_SQL_ABSENT = " UNION ALL ".join(
    f"SELECT 0 FROM (SELECT least(sz, 64) * least(sy, 64) * least(sx, 64) - (SELECT count(*) FROM l, g WHERE {_sql_window(f)}) AS k FROM g), unnest(range(k)) AS r(i)"
    for f in (0.33, 0.5, 0.66)
)


@query(f"WITH {SQL_3D}, {SQL_GRID_3D}, q AS ({_SQL_SAMPLE} UNION ALL {_SQL_ABSENT}), " + _SQL_OTSU.format(src="q"))
def auto_threshold_background(spark, sf):
    return occupancy.auto_threshold(rasters.li3d(spark, sf), rasters.meta3d(spark, sf))


@query(f"WITH {_SQL_OCC} SELECT tile_id FROM o WHERE occupied")
def skip_empty_semi(spark, sf):
    meta, occ = _occupancy(spark, sf)
    return occupancy.occupied_tiles(grid.tile_grid(spark, meta).select("tile_id"), occ)


@query(f"WITH {_SQL_OCC} SELECT CAST(t AS BIGINT) AS tile_id FROM g, unnest(range(nz * ny * nx)) AS r(t) WHERE t NOT IN (SELECT tile_id FROM o WHERE occupied)")
def empty_tiles_anti(spark, sf):
    meta, occ = _occupancy(spark, sf)
    return occupancy.empty_tiles(grid.tile_grid(spark, meta).select("tile_id"), occ)


# --- staging and merging -------------------------------------------------------


def _reach(where: str, same_tile: bool) -> str:
    """Least voxel of every component: recursion over face neighbours."""
    tile = " AND a.t = b.t" if same_tile else ""
    return f"""{SQL_2D}, {SQL_GRID_2D}, f AS (SELECT y, x, CAST(y AS BIGINT) * sx + x AS id, {TILE_ID_2D} AS t FROM e, g WHERE {where}),
n AS (SELECT a.id AS u, b.id AS v FROM f a JOIN f b ON ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)){tile}), b2 AS (SELECT u, v FROM n UNION SELECT v, u FROM n),
r AS (SELECT id AS u, id AS m FROM f UNION SELECT b2.u, r.m FROM r JOIN b2 ON b2.v = r.u), c AS (SELECT u AS id, min(m) AS comp FROM r GROUP BY u)"""


def _by_tile(staged_rows, meta):
    """Components named by their least voxel, with their tile."""
    v = grid.voxel_id(meta)
    name = staged_rows.groupBy("tile_id", "local").agg(F.min(v).alias("comp"))
    return staged_rows.join(name, ["tile_id", "local"])


@query(f"WITH RECURSIVE {_reach(f'value > {FOREGROUND}', True)} SELECT f.t AS tile_id, y, x, comp FROM f JOIN c USING (id)")
def tile_components(spark, sf):
    meta = rasters.meta2d(spark, sf, halo=0)
    rows = materialize(staged.stage_tiles(rasters.emb2d(spark, sf), _face_fn, meta), "staged")
    return _by_tile(rows, meta).select("tile_id", "y", "x", "comp")


@query(f"WITH RECURSIVE {_reach(f'value > {FOREGROUND}', True)}, k AS (SELECT f.t, count(DISTINCT comp) AS n FROM f JOIN c USING (id) GROUP BY 1) SELECT CAST(t AS BIGINT) AS tile_id, coalesce(n, 0) AS n FROM g, unnest(range(ny * nx)) AS r(t) LEFT JOIN k USING (t)")
def tile_label_counts(spark, sf):
    meta = rasters.meta2d(spark, sf, halo=0)
    rows = staged.stage_tiles(rasters.emb2d(spark, sf), _face_fn, meta)
    return merge.tile_counts(rows, grid.tile_grid(spark, meta))


_LABELS3D = "SELECT z, y, x, CAST(value AS BIGINT) AS label FROM l"


def _labels3d(spark, sf):
    return rasters.li3d(spark, sf).select("z", "y", "x", F.col("value").cast("bigint").alias("label"))


@query(f"WITH {SQL_3D}, {SQL_GRID_3D} SELECT {TILE_ID_3D} AS tile_id, z, y, x, dense_rank() OVER (PARTITION BY {TILE_ID_3D} ORDER BY value) AS local FROM l, g WHERE value > 0")
def dense_relabel_tile(spark, sf):
    return staged.dense_relabel(_labels3d(spark, sf), rasters.meta3d(spark, sf)).select("tile_id", "z", "y", "x", "local")


@query(f"WITH {SQL_3D} SELECT z, y, x, dense_rank() OVER (ORDER BY value) AS label FROM l WHERE value > 0")
def dense_relabel_store(spark, sf):
    rows = _labels3d(spark, sf).filter("label > 0")
    seq = merge.sequential(rows, "label").select(F.col("label").alias("old"), F.col("seq").alias("rep"))
    return merge.relabel(rows, seq)


_SQL_COUNTS = f"{SQL_3D}, {SQL_GRID_3D}, k AS (SELECT {TILE_ID_3D} AS tile_id, count(DISTINCT value) AS n FROM l, g WHERE value > 0 GROUP BY 1)"


@query(f"WITH {_SQL_COUNTS} SELECT tile_id, CAST(coalesce(sum(n) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM k")
def id_offsets(spark, sf):
    return merge.offsets(merge.tile_counts(staged.dense_relabel(_labels3d(spark, sf), rasters.meta3d(spark, sf))))


@query(
    f"""WITH {SQL_3D}, p AS (
SELECT least(a.value, b.value) AS lo, greatest(a.value, b.value) AS hi FROM l a JOIN l b ON b.z = a.z + 1 AND b.y = a.y AND b.x = a.x WHERE b.z % 3 = 0
UNION ALL SELECT least(a.value, b.value), greatest(a.value, b.value) FROM l a JOIN l b ON b.z = a.z AND b.y = a.y + 1 AND b.x = a.x WHERE b.y % 64 = 0
UNION ALL SELECT least(a.value, b.value), greatest(a.value, b.value) FROM l a JOIN l b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1 WHERE b.x % 64 = 0)
SELECT DISTINCT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM p WHERE lo > 0 AND lo <> hi"""
)
def touching_pairs(spark, sf):
    return merge.touching_pairs(_labels3d(spark, sf), rasters.meta3d(spark, sf))


@query(
    """WITH RECURSIVE b AS (SELECT lo AS v, hi AS u FROM pairs WHERE lo > 0 AND hi > 0 AND lo <> hi UNION SELECT hi, lo FROM pairs WHERE lo > 0 AND hi > 0 AND lo <> hi),
r AS (SELECT v, v AS m FROM b UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.v) SELECT v AS old, min(m) AS rep FROM r GROUP BY v"""
)
def relabel_lut(spark, sf):
    return merge.lookup_table(table(spark, sf, "pairs").filter("lo > 0 and hi > 0").select("lo", "hi"))


_WHOLE = _reach(f"value > {FOREGROUND}", False)


def _merged2d(spark, sf):
    """Haloed tiles: what touches only outside of a core is one object within the tile already, and meets again at the faces."""
    meta = rasters.meta2d(spark, sf)
    return meta, merge.tile_process(rasters.emb2d(spark, sf), _face_fn, meta)


@query(f"WITH RECURSIVE {_WHOLE} SELECT y, x, comp FROM f JOIN c USING (id)")
def merged_labels(spark, sf):
    meta, labels = _merged2d(spark, sf)
    return merge.canonical(labels, meta)


@query(f"WITH RECURSIVE {_WHOLE} SELECT y, x, dense_rank() OVER (ORDER BY comp) AS label FROM f JOIN c USING (id)")
def sequential_labels(spark, sf):
    meta, labels = _merged2d(spark, sf)
    named = materialize(merge.canonical(labels, meta), "named")
    seq = merge.sequential(named, "comp").select(F.col("comp").alias("old"), F.col("seq").alias("rep"))
    return merge.relabel(named, seq, "comp").select("y", "x", F.col("comp").alias("label"))


@query(f"WITH RECURSIVE {_WHOLE} SELECT count(DISTINCT comp) AS n_objects FROM c")
def object_count(spark, sf):
    return merge.object_count(_merged2d(spark, sf)[1])


@query(
    f"""WITH RECURSIVE {SQL_3D}, {SQL_GRID_3D}, f AS (SELECT z, y, x, (CAST(z AS BIGINT) * sy + y) * sx + x AS id FROM l, g WHERE value > 0),
n AS (SELECT a.id AS u, b.id AS v FROM f a JOIN f b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.id, b.id FROM f a JOIN f b ON b.z = a.z AND b.y = a.y + 1 AND b.x = a.x
UNION ALL SELECT a.id, b.id FROM f a JOIN f b ON b.z = a.z + 1 AND b.y = a.y AND b.x = a.x), b2 AS (SELECT u, v FROM n UNION SELECT v, u FROM n),
r AS (SELECT id AS u, id AS m FROM f UNION SELECT b2.u, r.m FROM r JOIN b2 ON b2.v = r.u WHERE r.m < b2.u), c AS (SELECT u AS id, min(m) AS comp FROM r GROUP BY u)
SELECT z, y, x, comp FROM f JOIN c USING (id)"""
)
def merged_labels_3d(spark, sf):
    meta = rasters.meta3d(spark, sf)
    return merge.canonical(merge.tile_process(rasters.li3d(spark, sf), _solid_fn, meta), meta)


@query(f"WITH RECURSIVE {_WHOLE}, s AS (SELECT comp, count(*) AS area, min(y) AS y_min, max(y) AS y_max FROM f JOIN c USING (id) GROUP BY 1) SELECT * FROM s")
def tile_process_e2e(spark, sf):
    """Threshold, tile, label, stitch and measure: the flagship."""
    meta, labels = _merged2d(spark, sf)
    return merge.canonical(labels, meta).groupBy("comp").agg(F.count("*").alias("area"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query(
    f"""WITH RECURSIVE {SQL_2D}, {SQL_GRID_2D},
h AS (SELECT y, x, value, ty * nx + tx AS t FROM e, g, unnest(range(greatest(y - 2, 0) // 32, least(y + 2, sy - 1) // 32 + 1)) a(ty), unnest(range(greatest(x - 2, 0) // 16, least(x + 2, sx - 1) // 16 + 1)) b(tx)),
o AS (SELECT t FROM h GROUP BY t HAVING max(value) > {FOREGROUND + 30}),
f AS (SELECT t, y, x, CAST(y AS BIGINT) * sx + x AS id FROM h JOIN o USING (t), g WHERE value > {FOREGROUND}),
n AS (SELECT a.t, a.id AS u, b.id AS v FROM f a JOIN f b ON a.t = b.t AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))), b2 AS (SELECT t, u, v FROM n UNION SELECT t, v, u FROM n),
r AS (SELECT t, id AS u, id AS m FROM f UNION SELECT b2.t, b2.u, r.m FROM r JOIN b2 ON b2.t = r.t AND b2.v = r.u), c AS (SELECT t, u AS id, min(m) AS comp FROM r GROUP BY t, u),
w AS (SELECT t, y + dy AS y, x + dx AS x, max(comp) AS lab FROM f JOIN c USING (t, id), unnest(range(-1, 2)) a(dy), unnest(range(-1, 2)) b(dx) GROUP BY ALL)
SELECT CAST(t AS BIGINT) AS tile_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, dense_rank() OVER (PARTITION BY t ORDER BY lab) AS local
FROM w, g WHERE y >= 0 AND x >= 0 AND y < sy AND x < sx AND (y // 32) * nx + x // 16 = t"""
)
def custom_tile_fn(spark, sf):
    """A configured function with grown labels on haloed tiles; tiles without a bright voxel do not run."""
    meta = rasters.meta2d(spark, sf)
    fn = staged.build_fn({"method": "threshold", "settings": {"threshold": FOREGROUND, "connectivity": "face"}, "dilate": 1})
    return staged.stage_tiles(rasters.emb2d(spark, sf), fn, meta, empty_threshold=FOREGROUND + 30)


_CHANNELS = f"""{SQL_CYX}, g AS (SELECT max(y) + 1 AS sy, max(x) + 1 AS sx FROM v), e AS (SELECT y, x, sum(value) AS value FROM v GROUP BY 1, 2),
f AS (SELECT y, x, CAST(y AS BIGINT) * sx + x AS id FROM e, g WHERE value > 1),
n AS (SELECT a.id AS u, b.id AS v FROM f a JOIN f b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)), b2 AS (SELECT u, v FROM n UNION SELECT v, u FROM n),
r AS (SELECT id AS u, id AS m FROM f UNION SELECT b2.u, r.m FROM r JOIN b2 ON b2.v = r.u), c AS (SELECT u AS id, min(m) AS comp FROM r GROUP BY u)"""


@query(f"WITH RECURSIVE {_CHANNELS} SELECT y, x, comp FROM f JOIN c USING (id)")
def channel_tile_fn(spark, sf):
    """A function that sees all channels of a haloed tile: components where they add up to more than 1."""
    from functools import partial

    rows = rasters.ev_cyx(spark, sf)
    meta = ImageMeta(("y", "x"), rasters.extent(rows, "yx"), rasters.TILE_YX, 3)
    labels = merge.tile_process(rows, partial(kernels.channel_label, threshold=1.0), meta, channels=5)
    return merge.canonical(labels, meta)


@query(
    """WITH RECURSIVE b AS (SELECT lo AS v, hi AS u FROM pairs WHERE lo > 0 AND hi > 0 AND lo <> hi UNION SELECT hi, lo FROM pairs WHERE lo > 0 AND hi > 0 AND lo <> hi),
r AS (SELECT v, v AS m FROM b UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.v) SELECT count(*) FILTER (m < v) AS n_remapped FROM (SELECT v, min(m) AS m FROM r GROUP BY v)"""
)
def remap_count(spark, sf):
    return merge.remap_count(relabel_lut(spark, sf))


# --- chunk tables ----------------------------------------------------------------


@query(SQL["merged_labels_3d"])
def chunk_merged_labels_3d(spark, sf):
    """``merged_labels_3d`` on chunk tables throughout."""
    meta = rasters.meta3d(spark, sf)
    labels = dense.tile_process(dense.to_chunks(rasters.li3d(spark, sf), meta, "int32"), _solid_fn, meta, "int32")
    return merge.canonical(dense.to_voxels(labels, meta, "int64", "label"), meta)


@query(f"WITH {SQL_3D} SELECT CAST(z // 2 AS INTEGER) AS bz, CAST(y // 24 AS INTEGER) AS by, CAST(x // 48 AS INTEGER) AS bx, CAST(max(value) AS BIGINT) AS vmax FROM l WHERE value <> 0 GROUP BY 1, 2, 3")
def chunk_block_max(spark, sf):
    """Bricks that do not line up with the chunks."""
    meta = rasters.meta3d(spark, sf)
    return dense.block_max(dense.to_chunks(rasters.li3d(spark, sf), meta, "int32"), meta, (2, 24, 48), "int32")


# --- relations and measurements ------------------------------------------------

_AB = f"""{SQL_3D}, a AS (SELECT z, y, x, CAST(1 + (y // 8) * 64 + x // 8 AS BIGINT) AS a_id FROM l WHERE value > 10),
b AS (SELECT z, y, x, CAST(1 + (z * 128 + y // 6) * 64 + x // 6 AS BIGINT) AS b_id FROM l WHERE value > 47)"""
_REL = f"""{_AB}, n AS (SELECT a_id, b_id, count(*) AS n FROM a JOIN b USING (z, y, x) GROUP BY 1, 2),
k AS (SELECT a_id, b_id AS "match", n AS overlap_voxels, n / CAST(sum(n) OVER (PARTITION BY a_id) AS DOUBLE) AS overlap_fraction, row_number() OVER (PARTITION BY a_id ORDER BY n DESC, b_id) AS i FROM n),
rel AS (SELECT a_id, "match", overlap_voxels, overlap_fraction FROM k WHERE i = 1)"""


def _ab(spark, sf):
    rows = rasters.li3d(spark, sf)
    a = rows.filter("value > 10").select("z", "y", "x", (1 + F.floor(F.col("y") / 8) * 64 + F.floor(F.col("x") / 8)).cast("bigint").alias("label"))
    b = rows.filter("value > 47").select("z", "y", "x", (1 + (F.col("z") * 128 + F.floor(F.col("y") / 6)) * 64 + F.floor(F.col("x") / 6)).cast("bigint").alias("label"))
    return a, b


def _rel(spark, sf):
    a, b = _ab(spark, sf)
    meta = rasters.meta3d(spark, sf)
    counts = dense.overlap_counts(dense.to_chunks(a, meta, "int64", "label"), dense.to_chunks(b, meta, "int64", "label"), meta)
    return a, b, relations.best_matches(counts)


@query(f"WITH {_REL} SELECT * FROM rel")
def label_relations(spark, sf):
    return _rel(spark, sf)[2]


@query(f"WITH {_REL}, t AS (SELECT a_id, count(*) AS c FROM a GROUP BY 1) SELECT a_id, \"match\", overlap_voxels, overlap_voxels / CAST(c AS DOUBLE) AS overlap_fraction FROM rel JOIN t USING (a_id)")
def label_relations_total(spark, sf):
    return relations.label_relations(*_ab(spark, sf), "zyx", denominator="total")


@query(f"WITH {_REL} SELECT a_id, \"match\", coalesce(overlap_voxels, 0) AS overlap_voxels, coalesce(overlap_fraction, 0.0) AS overlap_fraction FROM (SELECT DISTINCT a_id FROM a) LEFT JOIN rel USING (a_id)")
def relations_per_a(spark, sf):
    a, _, rel = _rel(spark, sf)
    return relations.relations_per_a(relations.label_ids(a), rel)


@query(f"WITH {_REL} SELECT b_id, count(a_id) AS n_a, CAST(coalesce(sum(overlap_voxels), 0) AS BIGINT) AS overlap_voxels FROM (SELECT DISTINCT b_id FROM b) LEFT JOIN rel ON b_id = \"match\" GROUP BY 1")
def relations_per_b(spark, sf):
    _, b, rel = _rel(spark, sf)
    return relations.relations_per_b(relations.label_ids(b), rel)


@query(f"WITH {_REL} SELECT DISTINCT a_id FROM a WHERE a_id NOT IN (SELECT a_id FROM rel)")
def relations_unmatched(spark, sf):
    a, _, rel = _rel(spark, sf)
    return relations.unmatched(relations.label_ids(a), rel)


@query(f"WITH {_AB} SELECT DISTINCT a_id AS id FROM a")
def id_set(spark, sf):
    return relations.label_ids(_ab(spark, sf)[0])


@query(
    f"""WITH {_AB} SELECT a_id AS label, count(*) AS area, CAST(sum(value) AS BIGINT) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
round(avg(z), 6) AS z_mean, round(avg(y), 6) AS y_mean, round(avg(x), 6) AS x_mean, min(z) AS z_min, min(y) AS y_min, min(x) AS x_min, max(z) AS z_max, max(y) AS y_max, max(x) AS x_max
FROM a JOIN l USING (z, y, x) GROUP BY 1"""
)
def region_props(spark, sf):
    out = relations.region_props(_ab(spark, sf)[0], rasters.li3d(spark, sf), "zyx")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "z_mean", "y_mean", "x_mean")})


@query("SELECT run_id, tile_id, max(local) AS n FROM staged GROUP BY run_id, tile_id")
def staged_tile_counts(spark, sf):
    return table(spark, sf, "staged").groupBy("run_id", "tile_id").agg(F.max("local").alias("n"))


# --- pyramids and kernels ------------------------------------------------------


@query(f"WITH {SQL_3D} SELECT CAST(i AS INTEGER) AS level, z, CAST(y // CAST(pow(2, i) AS INTEGER) AS INTEGER) AS y, CAST(x // CAST(pow(2, i) AS INTEGER) AS INTEGER) AS x, value FROM l, unnest(range(5)) AS r(i) WHERE y % CAST(pow(2, i) AS INTEGER) = 0 AND x % CAST(pow(2, i) AS INTEGER) = 0")
def pyramid_levels(spark, sf):
    return pyramid.pyramid(rasters.li3d(spark, sf), "zyx")


_SQL_SCALES = f"""WITH {SQL_3D}, {SQL_GRID_3D}, a AS (SELECT 'z' AS axis, sz AS s, 2.0 AS sc, 0 AS k FROM g UNION ALL SELECT 'y', sy, 0.5, 1 FROM g UNION ALL SELECT 'x', sx, 0.5, 1 FROM g)
SELECT CAST(i AS INTEGER) AS level, axis, CAST(ceil(s / pow(2, i * k)) AS INTEGER) AS size, CAST(sc * pow(2, i * k) AS DOUBLE) AS scale, 'micrometer' AS unit FROM a, unnest(range(5)) AS r(i)"""


@query(_SQL_SCALES)
def pyramid_scales(spark, sf):
    return pyramid.pyramid_meta(spark, rasters.meta3d(spark, sf).shape, "zyx", {"z": 2.0, "y": 0.5, "x": 0.5})


@query(
    f"""WITH p AS ({_SQL_SCALES}), l AS (SELECT level, list(scale ORDER BY strpos('tczyx', axis)) AS s, list({{'name': axis, 'type': 'space', 'unit': unit}} ORDER BY strpos('tczyx', axis)) AS a FROM p GROUP BY level)
SELECT CAST(to_json({{'multiscales': [{{'name': 'image', 'axes': min_by(a, level), 'datasets': list({{'path': CAST(level AS VARCHAR), 'coordinateTransformations': [{{'type': 'scale', 'scale': s}}]}} ORDER BY level)}}]}}) AS VARCHAR) AS attributes FROM l"""
)
def ngff_metadata(spark, sf):
    return pyramid.ngff_attributes(pyramid_scales(spark, sf), "image")


@query(
    f"""WITH {SQL_2D}, {SQL_GRID_2D}, f AS (SELECT y, x, CAST(value AS BIGINT) AS label FROM e WHERE value > {FOREGROUND})
SELECT CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, max(label) AS label FROM f, g, unnest(range(-1, 2)) a(dy), unnest(range(-1, 2)) b(dx)
WHERE y + dy >= 0 AND y + dy < sy AND x + dx >= 0 AND x + dx < sx GROUP BY 1, 2"""
)
def grow_labels(spark, sf):
    rows = rasters.emb2d(spark, sf).filter(F.col("value") > FOREGROUND).select("y", "x", F.col("value").cast("bigint").alias("label"))
    meta = rasters.meta2d(spark, sf)
    return dense.to_voxels(dense.grow(dense.to_chunks(rows, meta, "int64", "label"), meta), meta, "int64", "label")


def _sql_smooth(name: str, sigma: float) -> str:
    w = kernels.gaussian_weights(sigma)
    r = len(w) // 2
    taps = ", ".join(f"({i - r}, {x!r}::DOUBLE)" for i, x in enumerate(w.tolist()))
    step = lambda src, axis, other, size, out: (
        f"{out} AS (SELECT {other}, p + d AS {axis}, sum(v * w) AS v FROM (SELECT {other}, v, unnest([{axis}, -{axis} - 1, 2 * {size} - 1 - {axis}]) AS p, {size} AS s FROM {src}, g), (VALUES {taps}) t(d, w) WHERE p + d >= 0 AND p + d < s GROUP BY ALL)"
    )
    return ", ".join([step("e0", "y", "x", "sy", f"{name}y"), step(f"{name}y", "x", "y", "sx", name)])


@query(f"WITH {SQL_2D}, {SQL_GRID_2D}, e0 AS (SELECT y, x, CAST(value AS DOUBLE) AS v FROM e), {_sql_smooth('lo', 1.0)}, {_sql_smooth('hi', 3.0)} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(lo.v - hi.v, 5) + 0.0 AS response FROM lo JOIN hi USING (y, x)")
def dog_response(spark, sf):
    meta = rasters.meta2d(spark, sf)
    chunks = dense.dog(dense.to_chunks(rasters.emb2d(spark, sf), meta, "int32"), meta, 1.0, 3.0, "int32")
    out = dense.to_voxels(chunks, meta, "float64", "response", zeros=True)
    return out.select("y", "x", (F.round("response", 5) + F.lit(0.0)).alias("response"))


_DOG_T = 30.0


@query(
    f"""WITH RECURSIVE {SQL_2D}, {SQL_GRID_2D}, e0 AS (SELECT y, x, CAST(value AS DOUBLE) AS v FROM e), {_sql_smooth('lo', 1.0)}, {_sql_smooth('hi', 2.0)},
f AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(y AS BIGINT) * sx + CAST(x AS BIGINT) AS id FROM lo JOIN hi USING (y, x), g WHERE lo.v - hi.v > {_DOG_T}),
n AS (SELECT a.id AS u, b.id AS v FROM f a JOIN f b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)), b2 AS (SELECT u, v FROM n UNION SELECT v, u FROM n),
r AS (SELECT id AS u, id AS m FROM f UNION SELECT b2.u, r.m FROM r JOIN b2 ON b2.v = r.u), c AS (SELECT u AS id, min(m) AS comp FROM r GROUP BY u)
SELECT y, x, comp FROM f JOIN c USING (id)"""
)
def dog_labels(spark, sf):
    """Difference of Gaussians and components on haloed tiles; the halo covers the reach of the wider Gaussian."""
    meta = rasters.meta2d(spark, sf, halo=8)
    fn = staged.build_fn({"method": "dog", "settings": {"low_sigma": 1.0, "high_sigma": 2.0, "threshold": _DOG_T}})
    return merge.canonical(merge.tile_process(rasters.emb2d(spark, sf), fn, meta), meta)


@query(
    f"""WITH {SQL_2D} SELECT 'cells' AS name, CAST(i AS INTEGER) AS level, count(*) AS n_voxels FROM e, unnest(range(5)) AS r(i)
WHERE value > {FOREGROUND} AND y % CAST(pow(2, i) AS INTEGER) = 0 AND x % CAST(pow(2, i) AS INTEGER) = 0 GROUP BY 1, 2"""
)
def label_pyramid_publish(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/gridweave/store-{uuid.uuid4().hex}"
    labels = rasters.emb2d(spark, sf).filter(F.col("value") > FOREGROUND).select("y", "x", F.col("value").cast("bigint").alias("label"))
    sinks.write_labels(labels, path, "cells", ["y", "x"])
    return spark.read.parquet(f"{path}/labels").join(files.label_names(spark, path).select("name"), "name").groupBy("name", "level").agg(F.count("*").alias("n_voxels"))
