"""Schema drift, units and incremental runs: brute force, dirty inputs, recovery."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import drift, incremental, units
from gridweave.plans import problems

T0 = dt.datetime(2025, 1, 1)
ATTRS = "record_id bigint, store_id bigint, written_at timestamp_ntz, attrs string, part string, edge string"


def records(spark, rows):
    return spark.createDataFrame([(i, s, None if h is None else T0 + dt.timedelta(hours=h), a, "clash", "clash") for i, s, h, a in rows], ATTRS)


def changes(spark, rows):
    return sorted(tuple(r) for r in drift.schema_changes(records(spark, rows)).collect())


def test_each_kind_of_change(spark):
    rows = [
        (1, 1, 0, '{"a": 1, "b": [1, 2], "n": null}'),
        (2, 1, 1, '{"a": "1", "c": [1.0, 2e0], "n": 3}'),
        (3, 1, 2, '{"a": "1", "c": [1, 2], "d": {"e": true}}'),
        (4, 2, 0, '{"zzz": 1}'),
    ]
    assert changes(spark, rows) == [
        (2, "added", "", "n"), (2, "renamed", "b[]", "c[]"), (2, "retyped", "a", "a"), (3, "added", "", "d.e"), (3, "removed", "n", ""),
    ]


def test_ambiguous_values_are_not_renamed(spark):
    rows = [(1, 1, 0, '{"a": 5, "b": 5}'), (2, 1, 1, '{"c": 5}'), (3, 1, 2, '{"d": "5"}')]
    assert changes(spark, rows) == [
        (2, "added", "", "c"), (2, "removed", "a", ""), (2, "removed", "b", ""), (3, "added", "", "d"), (3, "removed", "c", ""),
    ]


def test_dirty_records_are_passed_over(spark):
    rows = [(1, 1, 0, '{"a": 1}'), (2, 1, 1, None), (3, 1, 2, '{"a": '), (4, 1, 3, ""), (5, 1, 4, '{"a": NaN}'), (6, None, 5, '{"q": 1}'), (7, 1, 6, '{"b": 1}'), (7, 1, 6, '{"b": 1}'), (8, 1, None, '{"a": 1}')]
    # Record 8 has no time and comes first; it equals record 1.
    assert changes(spark, rows) == [(7, "renamed", "a", "b")]
    assert changes(spark, rows[:0]) == []
    assert changes(spark, [(1, 1, 0, "[" * 100_000), (2, 1, 1, json.dumps({"a": "x" * 200_000})), (3, 1, 2, '{"b": "\\ud800"}')])[0][1:] == ("added", "", "b")


def test_one_store_spread_over_partitions_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        doc = {k: rng.choice([1, "1", 2.5, None, [1, "x"], {"k": rng.randint(0, 2)}]) for k in rng.sample("abcdef", rng.randint(0, 4))}
        rows.append((i, 1 if rng.random() < 0.6 else rng.randint(2, 40), rng.randint(0, 50), json.dumps(doc)))
    want, last = [], {}
    for i, s, h, a in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        now = drift.infer(drift.parse(a)[0])
        if s in last:
            want += [(i, *c) for c in drift.report(drift.fuse(last[s], now))]
        last[s] = now
    assert changes(spark, rows) == sorted(want)


def test_numbers_compare_by_value():
    c = drift.canonical_number
    assert c("1") == c("1.0") == c("10e-1") == c("0.1E1") and c("-0") == c("0.0") == "0"
    assert c("12345678901234567890123") != c("12345678901234567890124") and c("-1") != c("1")


def test_union_schema_keeps_alternatives(spark):
    rows = records(spark, [(1, 1, 0, '{"v": "0.4", "t": "x"}'), (2, 1, 1, '{"v": 0.5, "t": true}'), (2, 1, 1, '{"v": 0.5, "t": true}')])
    flat = drift.flatten(rows)
    got = {(r["path"], r["type"]): (r["n_records"], r["canonical"]) for r in drift.union_schema(flat).collect()}
    assert got == {("v", "string"): (1, "number"), ("v", "number"): (1, "number"), ("t", "string"): (1, "string"), ("t", "boolean"): (1, "string")}
    b = {r["record_id"]: r for r in drift.typed_branches(flat).filter("path = 'v'").collect()}
    assert b[1]["v_string"] == "0.4" and b[1]["v_number"] is None and b[1]["canonical_number"] == 0.4 and b[2]["v_number"] == 0.5
    assert {(r["path"], r["type"]) for r in drift.appearing_alternatives(flat).collect()} == {("v", "number"), ("t", "boolean")}


def test_fused_schemas_retain_the_branches_of_each():
    a, b, c = (drift.infer(drift.parse(t)[0]) for t in ('{"v": [1, "x"], "o": {"k": true}}', '{"v": [2.0]}', '{"v": ["x"], "w": 1}'))
    union = drift.fuse(a, b, c)
    assert {p: [t for t, _ in x] for p, x in union.items()} == {
        "v[]": [("number", "string"), ("number",), ("string",)], "o.k": [("boolean",), (), ()], "w": [(), (), ("number",)],
    }
    assert sorted(drift.report(drift.fuse(a, b))) == [("removed", "o.k", ""), ("retyped", "v[]", "v[]")]
    assert list(drift.report(drift.fuse(a, a))) == [] and drift.fuse() == {}


def test_all_layouts_come_into_one_table(spark):
    docs = [{"ms": [{"axis": a, "s": v} for a, v in zip("yx", ("0.5", k))], "n": str(k), "q": "yes"} for k in (7, 8)]
    docs += [{"ome": {"ms": [{"name": a, "s": v} for a, v in zip("yx", (0.5, k))]}, "n": k, "q": True} for k in (7, 8, 9)]
    rows = [(i, 1 + i % 2, i, json.dumps(d)) for i, d in enumerate(docs)] + [(2, 1, 2, json.dumps(docs[2])), (9, 1, 30, "[1"), (10, 1, 31, None)]
    got = drift.metadata_table(records(spark, rows)).collect()
    fields = {r["path"]: r["field"] for r in got}
    assert fields["ms[].axis"] == fields["ome.ms[].name"] == "ome.ms[].name" and fields["n"] == "n"
    assert {(r["record_id"], r["number"], r["text"]) for r in got if r["field"] == "n"} == {(0, 7.0, "7"), (1, 8.0, "8"), (2, 7.0, "7"), (3, 8.0, "8"), (4, 9.0, "9")}
    assert all(r["truth"] is True for r in got if r["field"] == "q") and sum(r["field"] == "q" for r in got) == 5
    # A rename seen once, and paths that stand side by side, stay apart.
    rows = [(1, 1, 0, '{"a": 5}'), (2, 1, 1, '{"b": 5}'), (3, 2, 0, '{"c": 6}'), (4, 2, 1, '{"d": 6}'), (5, 3, 0, '{"c": 7}'), (6, 3, 1, '{"d": 7}'), (7, 4, 0, '{"c": 1, "d": 2}')]
    assert {r["path"]: r["field"] for r in drift.metadata_table(records(spark, rows)).collect()} == {x: x for x in "abcd"}
    assert drift.metadata_table(records(spark, rows[:0])).count() == 0


@pytest.mark.parametrize(
    "value, unit, nm",
    [
        ("0.5", None, 500), ("0,5", "µm", 500), ("0.5", "\\u00B5m", 500), (" 2 ", "NM", 2), ("1", "Å", 0), ("10", "angstrom", 1), ("2e-3", "mm", 2000), ("1E-6", " m", 1000),
        ("0.00001", "inch", 254), ("+3", "UM", 3000), ("5 nm", None, 5), ("5nm", "mm", 5), ("7 pixels", "nm", None), ("7", "pixel", None), ("-1", "nm", None), ("0", "nm", None),
        ("NaN", None, None), ("inf", None, None), ("", None, None), (None, "nm", None), ("1e400", "nm", None), ("1e30", "m", None), ("0.0015", "um", 2), ("5", "", 5000), ("1.2.3", None, None), ("5 µm", "px", 5000),
    ],
)
def test_sizes(value, unit, nm):
    assert units.size_nm(value, unit) == nm


def test_places_of_precedence(spark):
    ome = '<OME><Pixels SizeX="4" PhysicalSizeX="0.2" PhysicalSizeXUnit="&#181;m" PhysicalSizeY=\'3\' PhysicalSizeYUnit=\'px\' PhysicalSizeZ=""/></OME>'
    rows = [
        (1, ome, "1.5", "micron"), (2, "ImageJ=1.5\nspacing=2\nunit=nm\n", None, None), (3, "ImageJ=1.5\nspacing=2\nunit=nm\n", "bad", None),
        (4, "note\nVOXEL SIZE: 0,5 × 0.6x2 nm\n", None, None), (5, "pixel size: see log\nPixel size: 3 x 4 mm", "7", "nm"), (6, None, None, None), (7, "", "1", "furlong"), (8, "x" * 500_000, None, None), (2, "ImageJ=1.5\nspacing=2\nunit=nm\n", None, None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "file_id bigint, image_description string, ij_spacing string, ij_unit string, size_nm int")
    got = {(r["file_id"], r["axis"]): r["size_nm"] for r in units.voxel_sizes(df).collect()}
    assert got == {(1, "x"): 200, (1, "z"): 1500, (2, "z"): 2, (4, "x"): 1, (4, "y"): 1, (4, "z"): 2, (5, "x"): 3_000_000, (5, "y"): 4_000_000, (5, "z"): 7}
    assert units.voxel_sizes(df).count() == len(got) and units.voxel_sizes(df.limit(0)).count() == 0


def test_sizes_are_those_of_the_text_without_a_decoder(spark, monkeypatch):
    """A silent size is in micrometres whatever its series holds, so no series may be built, written or decoded."""
    rows = [(i, 7, None, v, u, T0 + dt.timedelta(hours=i)) for i, (v, u) in enumerate([("2", "mm"), ("2", None), ("2000000", "nm"), ("2000000", ""), ("0.5", "px")])]
    df = spark.createDataFrame(rows, "file_id bigint, image_id bigint, image_description string, ij_spacing string, ij_unit string, acquired_at timestamp_ntz")
    for stage in ("decode_units", "with_series", "materialize"):
        monkeypatch.setattr(units, stage, lambda *a, stage=stage, **k: pytest.fail(f"{stage} is called"))
    assert {tuple(r) for r in units.voxel_sizes(df).collect()} == {(0, "z", 2_000_000), (1, "z", 2000), (2, "z", 2_000_000), (3, "z", 2_000_000_000)}


def _series(n=40, seed=0, at=(12, 25)):
    rng = np.random.default_rng(seed)
    level, state, rows = 500.0, "um", []
    for i in range(n):
        level *= 1 + rng.normal(0, 0.01)
        if i in at:
            state = "nm" if state == "um" else "um"
        rows.append((i, level / float(units.NM[state]), state))
    return rows


def _path(y, known=None, prior=None):
    n = len(units.STATES)
    prior = np.where(np.arange(n) == units.STATES.index("um"), 0.0, -8.0) if prior is None else prior
    known = np.full(len(y), -1) if known is None else known
    return units.viterbi(np.asarray(y), known, np.array([len(y)]), prior[None, :], np.array([-1]), 0.05, 8.0)


def test_many_series_at_once_are_decoded_as_each_alone():
    rng = np.random.default_rng(3)
    ys = [rng.normal(0, 2, rng.integers(1, 12)) for _ in range(50)]
    known = [np.where(rng.random(len(y)) < 0.2, rng.integers(0, 8, len(y)), -1) for y in ys]
    prior = np.tile(np.where(np.arange(8) == 3, 0.0, -8.0), (50, 1))
    got = units.viterbi(np.concatenate(ys), np.concatenate(known), np.array([len(y) for y in ys]), prior, np.full(50, -1), 0.05, 8.0)
    assert got.tolist() == np.concatenate([_path(y, k) for y, k in zip(ys, known)]).tolist()
    # Against all paths.
    y, k = np.array([0.1, 3.2, 0.0]), np.array([-1, -1, 2])
    score = lambda p: prior[0, p[0]] + sum(units._emissions(k)[i, s] for i, s in enumerate(p)) + sum(units._steps(y[i : i + 1] - y[i - 1 : i], 0.05, 8.0)[0, p[i - 1], p[i]] for i in (1, 2))
    assert _path(y, k).tolist() == list(max(np.ndindex(8, 8, 8), key=score))


def test_viterbi_finds_the_switches_and_blocks_agree(spark):
    rows = _series()
    path = [units.STATES[s] for s in _path(np.log10([v for _, v, _ in rows]))]
    assert path == [s for _, _, s in rows]
    data = [("s", T0 + dt.timedelta(hours=i), v, None, 1) for i, v, _ in rows] + [("s", None, 1.0, None, 1), (None, T0, 1.0, None, 1), ("s", T0, -1.0, None, 1), ("t", T0, 5.0, "mm", 1)]
    df = spark.createDataFrame(data, "series string, at timestamp_ntz, value double, unit string, block int")
    for parts in (1, 7, None):
        out = units.decode_units(df, parts=parts).collect()
        assert [r["state"] for r in sorted((r for r in out if r["series"] == "s"), key=lambda r: r["at"])] == path
        assert [r["state"] for r in out if r["series"] == "t"] == ["mm"]
    assert units.decode_units(df.limit(0)).count() == 0
    assert {r["state"] for r in units.decode_units(df, silent="um").collect() if r["series"] == "s"} == {"um"}


def test_accuracy_on_planted_switches(spark):
    """300 series of 5 to 60 readings with one or two silent switches between um and nm and a tenth of the units in the text: over 99 % of the readings."""
    rng = np.random.default_rng(9)
    data, truth = [], {}
    for k in range(300):
        n = int(rng.integers(5, 60))
        for i, v, state in _series(n, k, set(rng.integers(1, n, int(rng.integers(1, 3))).tolist())):
            data.append((str(k), T0 + dt.timedelta(minutes=i), v, state if rng.random() < 0.1 else None))
            truth[str(k), T0 + dt.timedelta(minutes=i)] = state
    out = units.decode_units(spark.createDataFrame(data, "series string, at timestamp_ntz, value double, unit string")).collect()
    assert len(out) == len(truth) and np.mean([truth[r["series"], r["at"]] == r["state"] for r in out]) > 0.99


COUNTS = "run_id bigint, tile_id bigint, n bigint, batch int, updated_at timestamp_ntz, arrived_at timestamp_ntz, part int, old int"
TILES = "manifest_id bigint, run_id bigint, written_at timestamp_ntz, arrived_at timestamp_ntz, batches array<array<int>>"
JOBS = "job_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, read_until timestamp_ntz, status string"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


COUNT_ROWS = [(1, 1, 5, 0, 1, 1), (1, 1, 6, 0, 2, 20), (1, 2, 5, 0, 1, 1), (1, 2, 5, 0, 1, 30), (1, 3, None, 0, 1, 20), (1, 4, 7, 0, 1, 20), (1, 4, 7, 0, 1, 20), (2, 1, 1, 0, 9, 1), (2, 1, 4, 0, 3, 20), (3, 1, 2, 0, 1, 1), (3, 1, 2, None, 2, 20), (None, 1, 2, 0, 1, 20), (4, 1, 2, 0, 1, None)]
TILE_ROWS = [(1, 1, 1, 1, [[1, 2], [3]]), (2, 1, 2, 20, [[2, 1], [3, 4], [5]]), (3, 2, 1, 1, [[1]]), (3, 2, 1, 1, [[1]]), (4, 3, 3, 20, [[1]]), (5, 4, 1, 20, None)]


def p6_tables(spark, path, counts, tiles, jobs):
    spark.createDataFrame([(a, b, n, k, at(u), at(v), 1, 1) for a, b, n, k, u, v in counts], COUNTS).write.parquet(f"{path}/counts.parquet")
    spark.createDataFrame([(m, r, at(w), at(v), b) for m, r, w, v, b in tiles], TILES).write.parquet(f"{path}/tiles.parquet")
    spark.createDataFrame([(j, at(s), at(f), at(u), x) for j, s, f, u, x in jobs], JOBS).write.parquet(f"{path}/job_log.parquet")
    return str(path)


def test_changed_items(spark, tmp_path):
    jobs = [(1, 0, 1, 10, " Succeeded "), (2, 0, 1, 25, "failed"), (3, 0, 1, None, "succeeded"), (4, 0, None, 5, None)]
    want = [("counts", 1, 1), ("counts", 1, 4), ("counts", 3, 1), ("counts", 4, 1), ("tiles", 1, 1), ("tiles", 1, 2), ("tiles", 3, 0)]
    path = p6_tables(spark, tmp_path / "a", COUNT_ROWS, TILE_ROWS, jobs)
    for q in (problems.p6_found, problems.p6_resumed):
        assert sorted(tuple(r) for r in q(spark, path).collect()) == want
    assert problems.p6_found(spark, p6_tables(spark, tmp_path / "b", [], [], [])).count() == 0
    first = problems.p6_found(spark, p6_tables(spark, tmp_path / "c", COUNT_ROWS, TILE_ROWS, []))
    assert first.filter("item_kind = 'counts'").count() == 6


@pytest.mark.parametrize("step", incremental.IncrementalRun.STEPS)
def test_runs_resume_without_skipping_or_repeating(spark, tmp_path, step):
    rows = [(r, t, 1, 0, at(1), at(1), 1, 1) for r in range(0, 96, 16) for t in range(3)]
    later = [(0, 0, 9, 0, at(2), at(11), 1, 1), (80, 7, 1, 0, at(2), at(11), 1, 1), (16, 1, 1, 0, at(1), at(12), 1, 1)]
    last = [(32, 2, 8, 0, at(3), at(21), 1, 1)]
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/runs", 5)

    def go(x, until, **options):
        found = run.run({"counts": (incremental.COUNTS, spark.createDataFrame(x, COUNTS))}, until, **options)["counts"]
        return sorted((r["run_id"], r["tile_id"], r["new"]["n"]) for r in found.collect())

    assert len(go(rows, "2025-01-01 10:00:00")) == 18
    with pytest.raises(RuntimeError):
        go(rows + later, "2025-01-01 20:00:00", fail_after=step)
    # More rows arrive before the retry; they belong to the next run.
    assert go(rows + later + last, "2025-01-01 23:00:00") == [(0, 0, 9), (80, 7, 1)]
    assert go(rows + later + last, "2025-01-01 23:00:00") == [(32, 2, 8)]
    state = {(r["run_id"], r["tile_id"]): r["n"] for r in run.state(incremental.COUNTS).collect()}
    assert len(state) == 19 and state[32, 2] == 8 and state[0, 0] == 9
    assert go(rows + later + last, "2025-01-01 23:30:00") == []


def test_only_changed_partitions_are_replaced_and_untimed_rows_stay_new(spark, tmp_path):
    rows = [(r, 0, 1, 0, at(1), at(1), 1, 1) for r in range(0, 320, 16)]
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/runs", 8)
    go = lambda x, until: run.run({"counts": (incremental.COUNTS, spark.createDataFrame(x, COUNTS))}, until)["counts"]
    go(rows, "2025-01-01 05:00:00")
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("runs/counts/state/part=*/*.parquet")}
    before = files()
    assert len({p.parent for p in before}) > 3
    assert go([*rows, (16, 0, 5, 0, at(2), at(6), 1, 1)], "2025-01-01 07:00:00").count() == 1
    assert len({p.parent for p in before} - {p.parent for p in before if p not in files()}) == len({p.parent for p in before}) - 1
    untimed = [*rows, (16, 0, 5, 0, at(2), at(6), 1, 1), (48, 0, 7, 0, at(3), None, 1, 1)]
    for hour in (8, 9):
        assert [r["run_id"] for r in go(untimed, f"2025-01-01 0{hour}:00:00").collect()] == [48]
    assert run.state(incremental.COUNTS).filter("run_id = 48").first()["n"] == 1


def test_all_sizes_of_all_places_are_decoded(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    ome = '<OME><Pixels PhysicalSizeX="0.5" PhysicalSizeY="500 nm" PhysicalSizeZ="2" PhysicalSizeZUnit="pixel"/></OME>'
    rows = [
        (1, 7, ome, "2.0", None, at), (2, 7, ome, "2000 nm", None, at + dt.timedelta(hours=1)), (3, 7, None, "2000", "px", at), (4, 7, "ImageJ=1\nspacing=2000\n", None, None, None),
        (5, 7, "Voxel size: 0.5 x 0.5 x 2 um", None, None, at), (5, 7, "Voxel size: 0.5 x 0.5 x 2 um", None, None, at), (6, None, None, "3", None, at),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, image_id bigint, image_description string, ij_spacing string, ij_unit string, acquired_at timestamp")
    df.write.parquet(f"{tmp_path}/tiff_meta.parquet")
    got = {(r["file_id"], r["axis"], r["place"]): (r["state"], round(r["size_nm"])) for r in problems.p2_decoded(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "x", "ome"): ("um", 500), (1, "y", "ome"): ("nm", 500), (1, "z", "ij_spacing"): ("um", 2000), (2, "x", "ome"): ("um", 500), (2, "y", "ome"): ("nm", 500),
        (2, "z", "ij_spacing"): ("nm", 2000), (4, "z", "imagej"): ("nm", 2000), (5, "x", "text"): ("um", 500), (5, "y", "text"): ("um", 500), (5, "z", "text"): ("um", 2000), (6, "z", "ij_spacing"): ("um", 3000),
    }


def test_fingerprints_see_any_change(spark):
    df = spark.createDataFrame([(1, 1, None, 2, True), (1, 2, 2, None, True), (1, 3, 9, 9, False)], "part int, i int, a int, b int, s boolean")
    a, b, c = (incremental.fingerprints(df.filter(f"i = {i}"), ["a", "b"], "s").first() for i in (1, 2, 3))
    assert a["h"] != b["h"] and (c["n"], c["h"], c["untimed"]) == (0, 0, 1)
