"""Queries of the general data-preparation problems (schema drift, units, incremental runs)."""

from __future__ import annotations

from ..operators import drift, incremental, units
from ..runtime import table, work_folder


def p1_found(spark, sf):
    return drift.schema_changes(table(spark, sf, "store_attrs"))


def p1_meta(spark, sf):
    return drift.metadata_table(table(spark, sf, "store_attrs"))


def p1_union_schema(spark, sf):
    return drift.union_schema(drift.flatten(table(spark, sf, "store_attrs")))


def p1_branches(spark, sf):
    return drift.typed_branches(drift.flatten(table(spark, sf, "store_attrs")))


def p1_appearing(spark, sf):
    return drift.appearing_alternatives(drift.flatten(table(spark, sf, "store_attrs")))


def p2_found(spark, sf):
    return units.voxel_sizes(table(spark, sf, "tiff_meta"))


def p2_decoded(spark, sf):
    """Units of all sizes of each file and axis, decoded from the jumps in the series of its image; units in text pin them.

    A file without an image is a series of its own; sizes without a time come last.
    """
    rows = units.with_series(units.size_readings(table(spark, sf, "tiff_meta")))
    out = units.decode_units(rows, "series", "acquired_at", "value", "unit", keep=["file_id", "image_id", "axis", "place"], untimed=True)
    return out.withColumnRenamed("at", "acquired_at").drop("series")


def _p6(spark, sf, fail_after=None):
    """The changes of a run over all rows after a run up to the watermark, if there is one."""
    logs = {
        "counts": (incremental.COUNTS, table(spark, sf, "counts").filter("n is not null")),
        "tiles": (incremental.TILES, table(spark, sf, "tiles")),
    }
    until = incremental.watermark(table(spark, sf, "job_log"))
    run = incremental.IncrementalRun(spark, work_folder(spark, "run"))
    if until is not None:
        run.run(logs, until)
    if fail_after:
        try:
            run.run(logs, None, fail_after=fail_after)
        except RuntimeError:
            pass
    return incremental.changed_items(run.run(logs, None))


def p6_found(spark, sf):
    return _p6(spark, sf)


def p6_resumed(spark, sf):
    """``p6_found`` where the second run breaks off while it replaces the states, and is taken up again."""
    return _p6(spark, sf, "state")


QUERIES = {f.__name__: f for f in (p1_found, p1_meta, p1_union_schema, p1_branches, p1_appearing, p2_found, p2_decoded, p6_found, p6_resumed)}

def _p2_readings(keep: str = "") -> str:
    """CTEs of every usable size of ``tiff_meta``, as e; ``keep`` names more columns of the table."""
    return rf"""f AS (SELECT DISTINCT file_id, {keep}coalesce(image_description, '') AS d, ij_spacing, ij_unit FROM tiff_meta),
k AS (SELECT *, regexp_extract(d, '<(?:\w+:)?Pixels\b([^>]*)', 1) AS px, regexp_matches(d, '<(?:\w+:)?Pixels\b') AS ome, starts_with(ltrim(d), 'ImageJ=') AS ij FROM f),
l AS (SELECT file_id, {keep}unnest(regexp_extract_all(d, '(?im)^[^\S\n]*(?:voxel|pixel) size:(.*)$', 1)) AS s FROM k WHERE NOT ome AND NOT ij),
w AS (SELECT file_id, {keep}regexp_extract(s, '^\s*([-+0-9.,eE]+)\s*[x×*]\s*([-+0-9.,eE]+)(?:\s*[x×*]\s*([-+0-9.,eE]+))?(.*)$', ['x', 'y', 'z', 'u']) AS q FROM l),
c AS (
  SELECT file_id, {keep}a AS axis, 1 AS rank, 'ome' AS place, regexp_extract(px, '\bPhysicalSize' || upper(a) || '="([^"]*)"', 1) AS v, regexp_extract(px, '\bPhysicalSize' || upper(a) || 'Unit="([^"]*)"', 1) AS u FROM k, unnest(['x', 'y', 'z']) AS r(a) WHERE ome
  UNION ALL SELECT file_id, {keep}'z', 2, 'ij_spacing', ij_spacing, ij_unit FROM k WHERE ij_spacing IS NOT NULL
  UNION ALL SELECT file_id, {keep}'z', 2, 'imagej', regexp_extract(d, '(?m)^spacing=(.*)$', 1), regexp_extract(d, '(?m)^unit=(.*)$', 1) FROM k WHERE ij_spacing IS NULL AND ij
  UNION ALL SELECT file_id, {keep}'x', 3, 'text', q['x'], q['u'] FROM w UNION ALL SELECT file_id, {keep}'y', 3, 'text', q['y'], q['u'] FROM w UNION ALL SELECT file_id, {keep}'z', 3, 'text', q['z'], q['u'] FROM w),
n AS (SELECT file_id, {keep}axis, rank, place, regexp_extract(v, '^\s*([-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?)(.*)$', ['x', 'own']) AS q, u FROM c),
z AS (SELECT file_id, {keep}axis, rank, place, try_cast(replace(q['x'], ',', '.') AS DOUBLE) AS value, try_cast(replace(q['x'], ',', '.') AS DECIMAL(38, 15)) AS x,
  replace(replace(lower(trim(CASE WHEN trim(q['own']) <> '' THEN q['own'] ELSE coalesce(u, '') END)), '\u00b5', 'μ'), 'µ', 'μ') AS u FROM n WHERE q['x'] <> ''),
e AS (SELECT file_id, {keep}axis, rank, place, value, x, u = '' AS silent, CASE
  WHEN u IN ('pm', 'picometer', 'picometers', 'picometre', 'picometres') THEN 0.001 WHEN u IN ('å', 'angstrom', 'angstroms', 'ångström') THEN 0.1
  WHEN u IN ('nm', 'nanometer', 'nanometers', 'nanometre', 'nanometres') THEN 1 WHEN u IN ('', 'um', 'μm', 'micron', 'microns', 'micrometer', 'micrometers', 'micrometre', 'micrometres') THEN 1000
  WHEN u IN ('mm', 'millimeter', 'millimeters', 'millimetre', 'millimetres') THEN 1000000 WHEN u IN ('cm', 'centimeter', 'centimeters', 'centimetre', 'centimetres') THEN 10000000
  WHEN u IN ('in', 'inch', 'inches') THEN 25400000 WHEN u IN ('m', 'meter', 'meters', 'metre', 'metres') THEN 1000000000 END AS nm FROM z WHERE x > 0)"""


SQL = {
    "p1_found": r"""
WITH r AS (SELECT DISTINCT record_id, store_id, written_at, attrs FROM store_attrs WHERE attrs IS NOT NULL AND json_valid(attrs) AND store_id IS NOT NULL),
o AS (SELECT record_id, lag(record_id) OVER (PARTITION BY store_id ORDER BY written_at NULLS FIRST, record_id) AS prev FROM r),
t AS (SELECT record_id, t.id, regexp_replace(regexp_replace(t.fullkey, '\[[0-9]+\]', '[]', 'g'), '^\$\.?', '') AS path, t.type, t.atom FROM r, json_tree(r.attrs) AS t),
v AS (SELECT record_id, id, replace(path, '"', '') AS path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, atom FROM t WHERE atom IS NOT NULL AND type NOT IN ('NULL', 'OBJECT', 'ARRAY')),
p AS (SELECT record_id, path, list_sort(list_distinct(list(kind))) AS types, list(kind || CASE WHEN kind = 'number' THEN CAST(CAST(atom AS DOUBLE) AS VARCHAR) ELSE CAST(atom AS VARCHAR) END ORDER BY id) AS vals FROM v GROUP BY ALL),
a AS (SELECT o.record_id, path, types, vals FROM o JOIN p ON p.record_id = o.prev),
b AS (SELECT o.record_id, path, types, vals FROM o JOIN p ON p.record_id = o.record_id WHERE o.prev IS NOT NULL),
g AS (SELECT *, count(*) OVER (PARTITION BY record_id, vals) AS n FROM a ANTI JOIN b USING (record_id, path)),
c AS (SELECT *, count(*) OVER (PARTITION BY record_id, vals) AS n FROM b ANTI JOIN a USING (record_id, path)),
m AS (SELECT g.record_id, g.path AS old_path, c.path AS new_path FROM g JOIN c ON g.record_id = c.record_id AND g.vals = c.vals AND g.n = 1 AND c.n = 1)
SELECT a.record_id, 'retyped' AS change_kind, path AS old_path, path AS new_path FROM a JOIN b USING (record_id, path) WHERE a.types <> b.types
UNION ALL SELECT record_id, 'renamed', old_path, new_path FROM m
UNION ALL SELECT record_id, 'removed', path, '' FROM g ANTI JOIN m ON g.record_id = m.record_id AND g.path = m.old_path
UNION ALL SELECT record_id, 'added', '', path FROM c ANTI JOIN m ON c.record_id = m.record_id AND c.path = m.new_path
""",
    "p6_found": """
WITH w AS (SELECT max(read_until) AS w FROM job_log WHERE lower(trim(status)) = 'succeeded'),
c AS (SELECT counts.*, arrived_at <= w AS old FROM counts, w WHERE n IS NOT NULL AND run_id IS NOT NULL AND tile_id IS NOT NULL),
cn AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_id, tile_id ORDER BY updated_at DESC NULLS LAST, arrived_at DESC NULLS LAST, n DESC, batch DESC NULLS LAST) = 1),
co AS (SELECT * FROM c WHERE old QUALIFY row_number() OVER (PARTITION BY run_id, tile_id ORDER BY updated_at DESC NULLS LAST, arrived_at DESC NULLS LAST, n DESC, batch DESC NULLS LAST) = 1),
t AS (SELECT tiles.*, arrived_at <= w AS old FROM tiles, w WHERE run_id IS NOT NULL),
tn AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at DESC NULLS LAST, arrived_at DESC NULLS LAST) = 1),
tl AS (SELECT * FROM t WHERE old QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at DESC NULLS LAST, arrived_at DESC NULLS LAST) = 1),
pos AS (SELECT tn.run_id, i, list_sort(list_distinct(tn.batches[i + 1])) AS now, list_sort(list_distinct(tl.batches[i + 1])) AS was,
        coalesce(len(tl.batches), 0) AS n_was
        FROM tn LEFT JOIN tl ON tn.run_id = tl.run_id, unnest(range(len(tn.batches))) AS r(i))
SELECT 'counts' AS item_kind, cn.run_id, cn.tile_id AS item_no FROM cn LEFT JOIN co ON cn.run_id = co.run_id AND cn.tile_id = co.tile_id
WHERE co.run_id IS NULL OR cn.n IS DISTINCT FROM co.n OR cn.batch IS DISTINCT FROM co.batch
UNION ALL
SELECT 'tiles', run_id, CAST(i AS BIGINT) FROM pos WHERE n_was <= i OR now IS DISTINCT FROM was
""",
}
SQL["p6_resumed"] = SQL["p6_found"]

_SQL_V = r"""r AS (SELECT DISTINCT record_id, store_id, written_at, attrs FROM store_attrs WHERE attrs IS NOT NULL AND json_valid(attrs)),
t AS (SELECT record_id, store_id, written_at, t.id, regexp_replace(regexp_replace(t.fullkey, '\[[0-9]+\]', '[]', 'g'), '^\$\.?', '') AS path, t.type, t.atom FROM r, json_tree(r.attrs) AS t),
v AS (SELECT record_id, store_id, written_at, id, replace(path, '"', '') AS path, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS type,
  CASE WHEN type = 'VARCHAR' THEN atom ->> '$' ELSE CAST(atom AS VARCHAR) END AS text FROM t WHERE atom IS NOT NULL AND type NOT IN ('NULL', 'OBJECT', 'ARRAY'))"""


def _sql_union(source: str) -> str:
    """CTEs k and u: the union schema of the scalars in ``source``."""
    return f"""k AS (SELECT path, type, count(DISTINCT record_id) AS n_records, min(written_at) AS first_at, max(written_at) AS last_at, bool_and(try_cast(text AS DOUBLE) IS NOT NULL) AS num,
  bool_and(lower(trim(text)) IN ('true', 'yes', '1', 'false', 'no', '0')) AS truth FROM {source} GROUP BY 1, 2),
u AS (SELECT path, type, n_records, first_at, last_at, count(*) OVER w AS n_types,
  CASE WHEN count(*) OVER w = 1 THEN type WHEN bool_or(type = 'boolean') OVER w AND bool_and(truth) OVER w THEN 'boolean' WHEN bool_and(num) OVER w AND NOT bool_or(type = 'boolean') OVER w THEN 'number' ELSE 'string' END AS canonical
  FROM k WINDOW w AS (PARTITION BY path))"""


_SQL_FLAT = f"{_SQL_V}, {_sql_union('v')}"
SQL["p1_union_schema"] = f"WITH {_SQL_FLAT} SELECT * FROM u"
SQL["p1_appearing"] = f"WITH {_SQL_FLAT} SELECT path, type, first_at, n_records FROM u x WHERE n_types > 1 AND first_at > (SELECT min(first_at) FROM u y WHERE y.path = x.path)"
SQL["p1_branches"] = f"""WITH {_SQL_FLAT} SELECT record_id, path, CAST(row_number() OVER (PARTITION BY record_id, path ORDER BY id) - 1 AS INTEGER) AS pos,
CASE WHEN type = 'boolean' THEN text = 'true' END AS v_boolean, CASE WHEN type = 'number' THEN CAST(text AS DOUBLE) END AS v_number, CASE WHEN type = 'string' THEN text END AS v_string, canonical,
text AS canonical_text, CASE WHEN canonical = 'number' THEN CAST(text AS DOUBLE) END AS canonical_number, CASE WHEN canonical = 'boolean' THEN lower(trim(text)) IN ('true', 'yes', '1') END AS canonical_boolean
FROM v JOIN (SELECT DISTINCT path, canonical FROM u) USING (path)"""

SQL["p2_found"] = f"""WITH {_p2_readings()}
SELECT file_id, axis, CAST(first(round(CAST(x AS DECIMAL(27, 15)) * CAST(nm AS DECIMAL(13, 3)), 0) ORDER BY rank) AS BIGINT) AS size_nm FROM e WHERE nm IS NOT NULL GROUP BY file_id, axis"""

# The Viterbi path of every series: a list of scores and a list of paths, one per state.
_SQL_STATES = "[" + ", ".join(f"({float(v)!r})::DOUBLE" for v in units.NM.values()) + "]"
_SQL_NAMES = "[" + ", ".join(f"'{u}'" for u in units.NM) + "]"
SQL["p2_decoded"] = f"""WITH RECURSIVE {_p2_readings("image_id, acquired_at, ")},
k8 AS (SELECT DISTINCT file_id, image_id, acquired_at, axis, place, value, CASE WHEN silent THEN NULL ELSE list_position({_SQL_STATES}, CAST(nm AS DOUBLE)) END AS known FROM e WHERE nm IS NOT NULL),
o AS (SELECT *, coalesce(CAST(image_id AS VARCHAR), 'file ' || file_id) || '/' || axis AS series FROM k8),
q AS (SELECT *, log10(value) AS y, row_number() OVER (PARTITION BY series ORDER BY acquired_at NULLS LAST, value, file_id, image_id, axis, place, known NULLS FIRST) AS i FROM o),
v AS (
  SELECT series, i, y, list_transform(range(1, 9), lambda j: (CASE WHEN j = 4 THEN 0.0 ELSE -8.0 END) + (CASE WHEN known IS NULL OR known = j THEN 0.0 ELSE -1e18 END)) AS score,
    list_transform(range(1, 9), lambda j: [j]) AS path FROM q WHERE i = 1
  UNION ALL
  SELECT series, i, y, list_transform(best, lambda b, j: b[1] + (CASE WHEN known IS NULL OR known = j THEN 0.0 ELSE -1e18 END)),
    list_transform(best, lambda b, j: list_append(path[CAST(b[2] AS INTEGER)], j)) FROM (
    SELECT q.series, q.i, q.y, q.known, v.path, list_transform(range(1, 9), lambda j: list_transform([list_transform(range(1, 9), lambda k:
      v.score[k] - 0.5 * pow((q.y - v.y + log10({_SQL_STATES}[j]) - log10({_SQL_STATES}[k])) / 0.05, 2) - (CASE WHEN j = k THEN 0.0 ELSE 8.0 END))], lambda s: [list_max(s), CAST(list_position(s, list_max(s)) AS DOUBLE)])[1]) AS best
    FROM v JOIN q ON q.series = v.series AND q.i = v.i + 1)),
f2 AS (SELECT series, path[list_position(score, list_max(score))] AS path FROM v QUALIFY row_number() OVER (PARTITION BY series ORDER BY i DESC) = 1)
SELECT file_id, image_id, acquired_at, axis, place, value, {_SQL_NAMES}[path[i]] AS state, value * {_SQL_STATES}[path[i]] AS size_nm FROM q JOIN f2 USING (series)"""

SQL["p1_meta"] = f"""WITH RECURSIVE {_SQL_V}, chg AS ({SQL["p1_found"]}),
pth AS (SELECT path, max(written_at) AS last_at, count(DISTINCT (record_id, type)) AS n_records FROM v GROUP BY 1),
ren AS (SELECT least(old_path, new_path) AS a, greatest(old_path, new_path) AS b FROM chg WHERE change_kind = 'renamed' GROUP BY ALL HAVING count(*) >= {drift.SUPPORT}),
held AS (SELECT DISTINCT record_id, path FROM v), both_ AS (SELECT DISTINCT a, b FROM ren JOIN held x ON x.path = a JOIN held y ON y.path = b AND y.record_id = x.record_id),
lnk AS (SELECT a, b FROM ren ANTI JOIN both_ USING (a, b)), two AS (SELECT a AS u, b AS w FROM lnk UNION SELECT b, a FROM lnk),
rr AS (SELECT path AS u, path AS m FROM pth UNION SELECT two.u, rr.m FROM rr JOIN two ON two.w = rr.u), grp AS (SELECT u AS path, min(m) AS g FROM rr GROUP BY 1),
fld AS (SELECT path, first_value(path) OVER (PARTITION BY g ORDER BY last_at DESC NULLS LAST, n_records DESC, path DESC) AS field FROM grp JOIN pth USING (path)),
named AS (SELECT v.* EXCLUDE (path), v.path AS was, field AS path, CAST(row_number() OVER (PARTITION BY record_id, v.path ORDER BY id) - 1 AS INTEGER) AS pos FROM v JOIN fld USING (path)), {_sql_union('named')}
SELECT record_id, store_id, written_at, path AS field, was AS path, pos, text, CASE WHEN canonical = 'number' THEN CAST(text AS DOUBLE) END AS number, CASE WHEN canonical = 'boolean' THEN lower(trim(text)) IN ('true', 'yes', '1') END AS truth
FROM named JOIN (SELECT DISTINCT path, canonical FROM u) USING (path)"""
