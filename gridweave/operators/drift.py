"""Schemas that drift between documents: tagged-union inference and change reports.

``infer`` reads a document as a schema: a path names the scalars that are not
null (object keys joined by ``.``, ``[]`` after each array step) and holds a
branch per JSON type among them. ``fuse`` unites parallel schemas and retains,
per path, the branches that each of them has. Every report is read off a fused
schema: two consecutive documents of a store give its changes
(``schema_changes``), all documents give the union schema with one typed branch
per type, a canonical type and the alternatives that appeared later
(``union_schema``, ``typed_branches``, ``appearing_alternatives``). Paths that
were renamed without ever standing side by side are one field of the table that
holds all documents (``metadata_table``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, small

#: The JSON types of scalars, in the order in which branches are listed.
TYPES = ("boolean", "number", "string")

_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$")


class _Num(str):
    """The text of a JSON number; no precision is lost."""


def canonical_number(text: str) -> str:
    """The same text for equal numbers: sign, digits without outer zeros, exponent."""
    sign, whole, frac, exp = _NUMBER.match(text).groups()
    digits = (whole + (frac or "")).lstrip("0")
    shift = len(digits) - len(digits.rstrip("0"))
    digits = digits.rstrip("0")
    if not digits:
        return "0"
    return f"{sign}{digits}e{int(exp or 0) - len(frac or '') + shift}"


def _no_constant(text: str):
    raise ValueError(text)


_decode = json.JSONDecoder(parse_int=_Num, parse_float=_Num, parse_constant=_no_constant).decode


def parse(text: str | None):
    """The document as Python objects and True, or None and False if it is null or not valid JSON.

    NaN and infinities are not JSON. Of repeated keys the last one holds. A
    document nested too deeply to be read counts as not valid.
    """
    if text is None:
        return None, False
    try:
        return _decode(text), True
    except (ValueError, RecursionError):
        return None, False


def scalars(doc) -> Iterator[tuple[str, str, str]]:
    """(path, type, text) of every scalar that is not null, in document order."""
    stack = [("", doc)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            stack.extend((path + "[]", v) for v in reversed(x))
        elif isinstance(x, bool):
            yield path, "boolean", "true" if x else "false"
        elif isinstance(x, _Num):
            yield path, "number", x
        elif isinstance(x, str):
            yield path, "string", x


#: A schema: path -> (the types of its branches, an exact digest of its list of values).
Schema = dict[str, tuple[tuple[str, ...], str]]


def infer(doc) -> Schema:
    """The schema of one document."""
    types: dict[str, set[str]] = {}
    values: dict[str, list[str]] = {}
    for path, kind, text in scalars(doc):
        types.setdefault(path, set()).add(kind)
        values.setdefault(path, []).append(kind[0] + (canonical_number(text) if kind == "number" else text))
    out: Schema = {}
    for path, kinds in types.items():
        digest = hashlib.blake2b(digest_size=16)
        for v in values[path]:
            raw = v.encode("utf-8", "surrogatepass")
            digest.update(len(raw).to_bytes(8, "little"))
            digest.update(raw)
        out[path] = (tuple(t for t in TYPES if t in kinds), digest.hexdigest())
    return out


def fuse(*schemas: Schema) -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """The union of parallel schemas: path -> its branches and digest in each of them, without branches where it is absent."""
    absent = ((), "")
    return {path: [s.get(path, absent) for s in schemas] for path in dict.fromkeys(p for s in schemas for p in s)}


def report(union: dict[str, list[tuple[tuple[str, ...], str]]]) -> Iterator[tuple[str, str, str]]:
    """(change_kind, old_path, new_path) from the fused schema of an earlier and a later document.

    A path that keeps some branch but gains or loses others, or has others
    instead, is retyped. A path all of whose branches appear is added, one all
    of whose branches vanish is removed; an appearing and a vanishing path of
    equal values, each the only one with them, are one renamed path.
    """
    gone, come = {}, {}
    for path, ((before, old), (after, new)) in union.items():
        if not before:
            come[path] = new
        elif not after:
            gone[path] = old
        elif before != after:
            yield "retyped", path, path
    n_gone, n_come = Counter(gone.values()), Counter(come.values())
    target = {v: p for p, v in come.items() if n_come[v] == 1}
    moved = {p: target[v] for p, v in gone.items() if n_gone[v] == 1 and v in target}
    for p, q in moved.items():
        yield "renamed", p, q
    for p in gone.keys() - moved.keys():
        yield "removed", p, ""
    for p in come.keys() - set(moved.values()):
        yield "added", "", p


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


_OUT = pa.schema(
    [("record_id", pa.int64()), ("change_kind", pa.string()), ("old_path", pa.string()), ("new_path", pa.string()), ("part", pa.int32()), ("edge", pa.string()), ("store_id", pa.int64())]
)
_OUT_DDL = "record_id bigint, change_kind string, old_path string, new_path string, part int, edge string, store_id bigint"


def _changes_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each record with the one before it in a sorted partition.

    The first and the last readable record of the partition also come out as
    edges, since their neighbours may lie in another partition.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_key = before = None
    first = True
    for batch in batches:
        rows: list[tuple] = []
        for store, written, record, attrs in zip(*(batch.column(c).to_pylist() for c in ("store_id", "_at", "record_id", "attrs"))):
            if (key := (store, written, record)) == last_key:
                continue
            doc, ok = parse(attrs)
            if not ok:
                continue
            last_key = key
            now = infer(doc)
            if before is not None and before[0] == store:
                rows += [(record, *(map(_clean, c)), None, None, None) for c in report(fuse(before[2], now))]
            if first:
                rows.append((record, "first", None, None, part, json.dumps(now), store))
                first = False
            before = (store, record, now)
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], schema=_OUT)
    if before is not None:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_OUT.names, (before[1], "last", None, None, part, json.dumps(before[2]), before[0])))], schema=_OUT
        )


def _changes_at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes between the last record of a partition and the first of the next: record_id, before, after."""
    read = lambda text: {p: (tuple(t), d) for p, (t, d) in json.loads(text).items()}
    names = ["record_id", "change_kind", "old_path", "new_path"]
    for batch in batches:
        rows = [(r, *map(_clean, c)) for r, a, b in zip(*(x.to_pylist() for x in batch.columns)) for c in report(fuse(read(a), read(b)))]
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)


def schema_changes(records: DataFrame) -> DataFrame:
    """Every change between consecutive documents of a store: record_id, change_kind, old_path, new_path.

    ``records`` needs record_id, store_id, written_at and attrs; other columns
    are ignored. Records follow one another by written_at, ties by record_id; a
    record without written_at comes first. Rows with null or unreadable attrs
    are passed over, rows without store_id belong to no store and are left out,
    rows that repeat a record count once. No records: no changes.

    The rows are range-partitioned by (store, time), so a store that holds a
    third of all rows is spread over many tasks; neighbours across a partition
    border are joined, one pair per border, and compared in many tasks too.
    """
    rows = (
        records.filter(F.col("attrs").isNotNull() & F.col("store_id").isNotNull())
        .select("store_id", F.col("written_at").cast("string").alias("_at"), "record_id", "attrs")
        .repartitionByRange("store_id", "_at", "record_id")
        .sortWithinPartitions("store_id", "_at", "record_id", "attrs")
    )
    found = materialize(rows.mapInArrow(_changes_in_partition, _OUT_DDL), "drift")
    inner = found.filter("edge is null").select("record_id", "change_kind", "old_path", "new_path")
    edge = lambda kind: found.filter(F.col("edge").isNotNull() & (F.col("change_kind") == kind))
    starts = edge("first").select("part", "record_id", "store_id", F.col("edge").alias("after"))
    ends = edge("last").select(F.col("part").alias("_prev"), F.col("store_id").alias("_store"), F.col("edge").alias("before"))
    # The partition before each that has records: one window over the numbers of partitions, nothing else.
    order = found.filter("edge is not null").select("part").distinct().withColumn("_prev", F.lag("part").over(Window.orderBy("part")))
    near = starts.join(order, "part").join(ends, "_prev").filter("store_id = _store").select("record_id", "before", "after")
    return inner.unionByName(near.mapInArrow(_changes_at_edges, "record_id bigint, change_kind string, old_path string, new_path string"))


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("record_id", pa.int64()), ("store_id", pa.int64()), ("written_at", pa.string()), ("path", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("text", pa.string())]
    )
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for record, store, at, attrs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            doc, ok = parse(attrs)
            seen: Counter = Counter()
            for path, kind, text in scalars(doc) if ok else ():
                for col, v in zip(out, (record, store, at, _clean(path), seen[path], kind, _clean(text))):
                    col.append(v)
                seen[path] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def flatten(records: DataFrame) -> DataFrame:
    """One row per scalar: record_id, store_id, written_at, path, pos, type, text.

    Unreadable documents give no rows; a repeated row gives its scalars once.
    """
    rows = records.select("record_id", "store_id", F.col("written_at").cast("string").alias("written_at"), "attrs").dropDuplicates()
    return rows.mapInArrow(_flatten, "record_id bigint, store_id bigint, written_at string, path string, pos int, type string, text string").withColumn(
        "written_at", F.col("written_at").cast("timestamp_ntz")
    )


#: Texts that read as truth values (fixed values).
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


def _number(text) -> Column:
    return F.expr(f"try_cast({text} AS double)")


def _truth(text: str) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def union_schema(flat: DataFrame) -> DataFrame:
    """The fused schema: per path and branch, records, first appearance and whether the path conflicts.

    Columns: path, type, n_records, first_at, last_at, n_types, canonical. The
    canonical type of a path is its only type; ``boolean`` if it has that
    branch and all its texts read as truth values, ``number`` if it has none
    and all read as numbers, else ``string``. Fused per task before anything
    is shuffled; the number of rows is that of the schema, not of the data.
    """
    alt = (
        flat.groupBy("path", "type", "record_id")
        .agg(F.min("written_at").alias("at"), F.min(_number("text").isNotNull()).alias("numeric"), F.min(_truth("text").isNotNull()).alias("truth"))
        .groupBy("path", "type")
        .agg(F.count("*").alias("n_records"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("numeric").alias("numeric"), F.min("truth").alias("truth"))
    )
    per_path = alt.groupBy("path").agg(
        F.count("*").alias("n_types"), F.min("numeric").alias("numeric"), F.min("truth").alias("truth"), F.max(F.col("type") == "boolean").alias("has_bool"), F.min("type").alias("only")
    )
    kind = F.when(F.col("n_types") == 1, F.col("only")).when(F.col("has_bool") & F.col("truth"), F.lit("boolean")).when(F.col("numeric") & ~F.col("has_bool"), F.lit("number"))
    return alt.drop("numeric", "truth").join(per_path.select("path", "n_types", kind.otherwise(F.lit("string")).alias("canonical")), "path")


def typed_branches(flat: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every scalar with one branch per type and its canonical text, number and truth value.

    Columns: record_id, path, pos, those of ``keep``, v_boolean, v_number,
    v_string, canonical, canonical_text, canonical_number, canonical_boolean.
    The branch of the scalar's own type is filled, the others are null.
    """
    kinds = materialize(union_schema(flat).select("path", "canonical").distinct(), "union-schema")
    return flat.join(small(kinds), "path").select(
        "record_id", "path", "pos", *keep,
        F.when(F.col("type") == "boolean", F.col("text") == "true").alias("v_boolean"),
        F.when(F.col("type") == "number", _number("text")).alias("v_number"),
        F.when(F.col("type") == "string", F.col("text")).alias("v_string"),
        "canonical",
        F.col("text").alias("canonical_text"),
        F.when(F.col("canonical") == "number", _number("text")).alias("canonical_number"),
        F.when(F.col("canonical") == "boolean", _truth("text")).alias("canonical_boolean"),
    )


def appearing_alternatives(flat: DataFrame) -> DataFrame:
    """Types that a path took on after it had been seen with another: path, type, first_at."""
    alt = materialize(union_schema(flat), "union-schema")
    first = alt.groupBy("path").agg(F.min("first_at").alias("path_from"))
    return alt.join(first, "path").filter((F.col("n_types") > 1) & (F.col("first_at") > F.col("path_from"))).select("path", "type", "first_at", "n_records")


# --- one consistent table -----------------------------------------------------

#: Renames from one path to another that are needed to take the two for one field.
SUPPORT = 2


def fields(flat: DataFrame, changes: DataFrame, support: int = SUPPORT) -> DataFrame:
    """path, field: the name under which each path comes into the table.

    Paths between which ``support`` renames or more were seen, and which never
    stand in one record together, are one field; so are those linked through
    others. The field is called by the path that was written last (of equals
    the one of more records, then the least). Paths are few; they are compared
    by joins all the same.
    """
    from .merge import components

    paths = materialize(union_schema(flat).groupBy("path").agg(F.max("last_at").alias("last_at"), F.sum("n_records").alias("n_records")).withColumn("id", F.xxhash64("path")), "paths")
    moved = changes.filter("change_kind = 'renamed'").groupBy(F.least("old_path", "new_path").alias("a"), F.greatest("old_path", "new_path").alias("b"))
    moved = materialize(moved.agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("a", "b"), "renames")
    held = flat.select("record_id", "path").distinct()
    both = held.join(small(moved), F.col("path") == F.col("a")).select("record_id", "a", "b").join(held, "record_id").filter("path = b").select("a", "b").distinct()
    links = moved.join(both, ["a", "b"], "left_anti").select(F.xxhash64("a").alias("lo"), F.xxhash64("b").alias("hi"))
    group = components(links).select(F.col("old").alias("id"), "rep")
    rows = paths.join(group, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    latest = rows.groupBy("rep").agg(F.max_by("path", F.struct("last_at", "n_records", "path")).alias("field"))
    return rows.join(latest, "rep").select("path", "field")


def metadata_table(records: DataFrame) -> DataFrame:
    """All documents in one table: record_id, store_id, written_at, field, path, pos, text, number, truth.

    One row per scalar. ``field`` unites the paths that a field has had,
    ``path`` is that of the document; text is as recorded, number and truth are
    the canonical conversion of the field, null where it has another canonical
    type. Unreadable documents give no rows; a repeated row counts once.
    """
    flat = materialize(flatten(records), "flat")
    names = small(materialize(fields(flat, schema_changes(records)), "fields"))
    named = flat.join(names, "path").withColumnRenamed("path", "_path").withColumnRenamed("field", "path")
    rows = typed_branches(named, ["store_id", "written_at", "_path"])
    return rows.select(
        "record_id", "store_id", "written_at", F.col("path").alias("field"), F.col("_path").alias("path"), "pos",
        F.col("canonical_text").alias("text"), F.col("canonical_number").alias("number"), F.col("canonical_boolean").alias("truth"),
    )
