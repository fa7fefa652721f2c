"""Queries of the corpus and label-set problems."""

from __future__ import annotations

from ..runtime import table
from . import bpe, components, leak, overlap, spans, split


def p3_found(spark, sf):
    return overlap.heavy_pairs(overlap.members(table(spark, sf, "labels"), "label_name", "labels"))


def p3_overlaps(spark, sf):
    return overlap.overlaps(overlap.members(table(spark, sf, "labels"), "label_name", "labels"))


def p4_found(spark, sf):
    return split.split_tiles(table(spark, sf, "tiles"))


def p4_text_pieces(spark, sf):
    return split.split_texts(table(spark, sf, "documents"))


def p5_found(spark, sf):
    return components.groups(table(spark, sf, "pairs"), table(spark, sf, "staged"))


def p7_ids(spark, sf):
    return bpe.encode(table(spark, sf, "documents"))


def p8_found(spark, sf):
    return leak.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark, sf):
    return spans.shared_chars(table(spark, sf, "documents"))


def p9_passages(spark, sf):
    return spans.passages(table(spark, sf, "documents"))


def p9_members(spark, sf):
    return spans.passage_members(table(spark, sf, "documents"))


def p9_copies(spark, sf):
    return spans.copies(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_overlaps, p4_found, p4_text_pieces, p5_found, p7_ids, p8_found, p9_found, p9_passages, p9_members, p9_copies)
}

SQL = {
    "p3_found": """
WITH s AS (SELECT DISTINCT lower(trim(label_name)) AS name, labels AS id FROM labels WHERE label_name IS NOT NULL AND labels IS NOT NULL AND labels <> 0),
n AS (SELECT name, count(*) AS size FROM s GROUP BY name),
p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS shared FROM s a JOIN s b ON a.id = b.id AND a.name < b.name GROUP BY ALL)
SELECT name_a, name_b FROM p JOIN n x ON x.name = name_a JOIN n y ON y.name = name_b WHERE 2 * shared >= least(x.size, y.size)
""",
    "p4_found": r"""
WITH RECURSIVE t AS (SELECT DISTINCT manifest_id, tile_shape AS s, chunk_shape AS c, max_voxels AS m, overlap AS o, len(tile_shape) AS d,
    list_product(tile_shape)::BIGINT AS vol, list_position(tile_shape, list_max(tile_shape)) AS ax FROM tiles WHERE max_voxels IS NOT NULL),
u AS (SELECT *, CASE WHEN o IS NULL THEN 0 WHEN regexp_full_match(trim(o), '[0-9]+') THEN trim(o)::BIGINT
    WHEN regexp_full_match(trim(o), '\[ *[0-9]+( *, *[0-9]+)* *\]') AND len(string_split(o, ',')) = d THEN trim(string_split(trim(o, ' []'), ',')[ax])::BIGINT END AS h
    FROM t WHERE vol > m),
v AS (SELECT manifest_id, ['z', 'y', 'x'][3 - d + ax] AS axis, s[ax]::BIGINT AS n, m // (vol // s[ax]) AS w, c[ax]::BIGINT AS c, h FROM u WHERE h IS NOT NULL),
p AS (
  SELECT manifest_id, axis, n, w, c, h, 1 AS piece_no, 0::BIGINT AS a,
    CASE WHEN n <= w THEN n WHEN c IS NOT NULL AND (w // c) * c > h THEN (w // c) * c ELSE w END AS e FROM v WHERE w > h
  UNION ALL
  SELECT manifest_id, axis, n, w, c, h, piece_no + 1, e - h,
    CASE WHEN n - (e - h) <= w THEN n WHEN c IS NOT NULL AND ((e - h + w) // c) * c > e THEN ((e - h + w) // c) * c ELSE e - h + w END FROM p WHERE e < n)
SELECT manifest_id, piece_no, axis, a AS piece_from, e AS piece_to FROM p
""",
    "p5_found": """
WITH RECURSIVE k AS (SELECT DISTINCT labels AS id FROM staged WHERE labels IS NOT NULL AND labels <> 0),
e AS (SELECT DISTINCT lo, hi FROM pairs WHERE lo <> hi AND lo IN (FROM k) AND hi IN (FROM k)),
b AS (SELECT lo AS v, hi AS u FROM e UNION SELECT hi, lo FROM e),
r AS (SELECT v, v AS m FROM b UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.v)
SELECT v AS labels, min(m) AS group_id FROM r GROUP BY v
""",
    "p8_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS r(k)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS r(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p9_found": """
WITH g AS (SELECT doc_id, k, md5(substring(text, k, 240)) AS h FROM documents, unnest(range(1, length(text) - 238)) AS r(k)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, k, max(k + 239) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g JOIN s USING (h))
SELECT doc_id, CAST(sum(least(240, k + 239 - coalesce(upto, 0))) AS BIGINT) AS shared_chars FROM m GROUP BY doc_id
""",
    "p9_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep_id, length(text) AS n_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
}

# Where each boundary of a text lies: a mark after every match, and the summed lengths of the parts before the marks. The white space is that of Unicode.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = (
    (r"\n(diff --git |@@ |#{1,6} |={3,}|-{3,})", r"chr(10) || chr(57344) || '\1'"),
    (r"(\r?\n[ \t]*\r?\n)", r"'\1' || chr(57344)"),
    (rf"([.!?。！？]+[\"'')\]]*{_SPACE}+|\r?\n)", r"'\1' || chr(57344)"),
    (rf"({_SPACE}+)", r"'\1' || chr(57344)"),
)


def _ends(pattern: str, to: str) -> str:
    parts = f"list_transform(string_split(regexp_replace(text, '{pattern}', {to}, 'g'), chr(57344)), lambda x: length(x))"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: CAST(list_sum(({parts})[1:i]) AS BIGINT))"


SQL["p4_text_pieces"] = f"""WITH RECURSIVE d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text <> ''),
b AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS level, unnest({_ends(p, t)}) AS pos FROM d WHERE n > 1024" for k, (p, t) in enumerate(_MARKS))}),
l AS (SELECT doc_id, level, list(pos) AS pos FROM b GROUP BY 1, 2), m AS (SELECT d.*, a.pos AS s0, b.pos AS s1, c.pos AS s2, e.pos AS s3 FROM d LEFT JOIN l a ON a.doc_id = d.doc_id AND a.level = 0
  LEFT JOIN l b ON b.doc_id = d.doc_id AND b.level = 1 LEFT JOIN l c ON c.doc_id = d.doc_id AND c.level = 2 LEFT JOIN l e ON e.doc_id = d.doc_id AND e.level = 3),
p AS (
  SELECT doc_id, CAST(0 AS INTEGER) AS no, CAST(0 AS BIGINT) AS a, CAST(64 AS BIGINT) AS e FROM m
  UNION ALL
  SELECT p.doc_id, p.no + 1, CASE WHEN no = 0 THEN 0 ELSE p.e - 64 END, CASE WHEN n - (CASE WHEN no = 0 THEN 0 ELSE p.e - 64 END) <= 1024 THEN n ELSE
    coalesce({", ".join(f"list_max(list_filter(s{k}, lambda x: x > (CASE WHEN no = 0 THEN 64 ELSE p.e END) AND x <= (CASE WHEN no = 0 THEN 0 ELSE p.e - 64 END) + 1024))" for k in range(4))}, (CASE WHEN no = 0 THEN 0 ELSE p.e - 64 END) + 1024) END
  FROM p JOIN m USING (doc_id) WHERE no = 0 OR p.e < n)
SELECT doc_id, no AS piece_no, a AS piece_from, e AS piece_to, substring(text, a + 1, e - a) AS piece FROM p JOIN d USING (doc_id) WHERE no > 0"""
