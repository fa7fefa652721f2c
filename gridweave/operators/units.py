"""Quantities recorded in different units: a hidden Markov model with the unit as its state.

``size_readings`` takes sizes and the units beside them from the texts of a
file. ``decode_units`` treats the unit of a series of readings as the hidden
state of a Markov chain: a unit in the text is an emission that only one state
can give, the logarithm of a silent reading jumps when the unit switches while
the underlying level stays smooth, and the Viterbi path names the unit of each
reading. ``voxel_sizes`` has no hidden state: there a size without a unit is in
micrometres, so the text alone names every unit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, small

#: Nanometres per unit (fixed values).
NM = {
    "pm": Decimal("0.001"),
    "angstrom": Decimal("0.1"),
    "nm": Decimal(1),
    "um": Decimal(1000),
    "mm": Decimal(10) ** 6,
    "cm": Decimal(10) ** 7,
    "inch": Decimal(25_400_000),
    "m": Decimal(10) ** 9,
}
#: The states of the Markov model, by size.
STATES = tuple(NM)
#: The unit of a size that no text gives one.
DEFAULT = "um"

_PREFIX = {"pico": "pm", "nano": "nm", "micro": "um", "milli": "mm", "centi": "cm", "": "m"}
_NAMES = {f"{p}{stem}{s}": u for p, u in _PREFIX.items() for stem in ("meter", "metre") for s in ("", "s")}
_NAMES |= {u: u for u in ("pm", "nm", "um", "mm", "cm", "m")}
_NAMES |= dict.fromkeys(("µm", "micron", "microns", "mum", "mu m", "mcm", "micro m"), "um")
_NAMES |= dict.fromkeys(("å", "angstrom", "angstroms", "ångström", "ångströms", "ångstrom", "angström", "ång", "ang"), "angstrom")
_NAMES |= dict.fromkeys(("in", "inch", "inches", '"', "″"), "inch")
# NFKC turns the micro sign into a Greek mu and the angstrom sign into a letter.
_NAMES = {unicodedata.normalize("NFKC", k): v for k, v in _NAMES.items()}

_ESCAPED = re.compile(r"\\+u([0-9a-fA-F]{4})")
_VALUE = re.compile(r"\s*([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)(.*)$", re.S)
_PIXELS = re.compile(r"<(?:\w+:)?Pixels\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", re.S)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_SIZE_LINE = re.compile(r"^[^\S\n]*(?:voxel|pixel) size:(.*)$", re.I | re.M)
_LINE = r"^[^\S\n]*{}[^\S\n]*=(.*)$"
_SPACING, _UNIT = re.compile(_LINE.format("spacing"), re.M), re.compile(_LINE.format("unit"), re.M)
_NUM = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"
_SIZES = re.compile(rf"\s*({_NUM})\s*[x×*]\s*({_NUM})(?:\s*[x×*]\s*({_NUM}))?(.*)$", re.I | re.S)


def unit_of(text: str) -> str | None:
    """The unit that a text names, "" if it is blank, None if it names no length."""
    text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    text = " ".join(unicodedata.normalize("NFKC", text).strip().strip("[]()").split()).lower().rstrip(".")
    return _NAMES.get(text) if text else ""


def number_of(text: str) -> Decimal | None:
    """A positive finite number with decimal point or comma, else None."""
    try:
        x = Decimal(text.strip().replace(",", "."))
        return x if x.is_finite() and x > 0 and 0 < float(x) < float("inf") else None
    except (InvalidOperation, OverflowError):
        return None


def reading(value: str | None, unit: str | None) -> tuple[Decimal, str] | None:
    """The number and the unit of a size, "" if no unit is given, or None if either is unusable.

    A unit in the value's own text goes before ``unit``.
    """
    if value is None or not (m := _VALUE.match(unescape(value))):
        return None
    own = unit_of(m[2])
    name = own if own != "" else unit_of(unescape(unit)) if unit is not None else ""
    x = number_of(m[1])
    return None if x is None or name is None else (x, name)


def _whole_nm(x: Decimal, unit: str) -> int | None:
    nm = (x * NM[unit or DEFAULT]).to_integral_value(ROUND_HALF_UP)
    return int(nm) if nm < 2**63 else None


def size_nm(value: str | None, unit: str | None) -> int | None:
    """Whole nanometres, rounded half up, or None if value or unit is unusable.

    A value without a unit is in micrometres. Sizes beyond BIGINT are unusable.
    """
    if (found := reading(value, unit)) is None:
        return None
    return _whole_nm(*found)


def size_texts(description: str | None, ij_spacing: str | None, ij_unit: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """axis, place, value and unit as text of every size of one file, by the order of precedence of the places."""
    text = description or ""
    pixels = _PIXELS.search(text)
    imagej = text.lstrip().startswith("ImageJ=")
    if pixels:
        attrs = {m[1]: m[2] if m[2] is not None else m[3] for m in _ATTR.finditer(pixels[1])}
        for axis in "xyz":
            key = f"PhysicalSize{axis.upper()}"
            yield axis, "ome", attrs.get(key), attrs.get(key + "Unit")
    if ij_spacing is not None:
        yield "z", "ij_spacing", ij_spacing, ij_unit
    elif imagej:
        spacing, unit = _SPACING.search(text), _UNIT.search(text)
        yield "z", "imagej", spacing and spacing[1], unit and unit[1]
    if not pixels and not imagej:
        for line in _SIZE_LINE.finditer(text):
            if m := _SIZES.match(line[1]):
                for axis, value in zip("xyz", m.groups()[:3]):
                    yield axis, "text", value, m[4]


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.int64()]
    names = ["file_id", "image_id", "acquired_at", "axis", "place", "rank", "value", "number", "unit", "nm"]
    for batch in batches:
        out: list[tuple] = []
        for i, (file, image, *texts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)))):
            for rank, (axis, place, value, unit) in enumerate(size_texts(*texts)):
                if (found := reading(value, unit)) is not None and (nm := _whole_nm(*found)) is not None:
                    out.append((file, image, i, axis, place, rank, float(found[0]), str(found[0]), found[1] or None, nm))
        cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)]
        cols[2] = batch.column(2).take(cols[2])  # of the row that the size is from
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _all_readings(files: DataFrame) -> DataFrame:
    """The rows of ``size_readings`` with repeats, and nm: whole nanometres, silent sizes taken as ``DEFAULT``. A narrow map."""
    for c, kind in (("image_id", "bigint"), ("acquired_at", "timestamp_ntz")):
        files = files if c in files.columns else files.withColumn(c, F.lit(None).cast(kind))
    rows = files.select("file_id", "image_id", "acquired_at", "image_description", "ij_spacing", "ij_unit")
    kind = files.schema["acquired_at"].dataType.simpleString()
    ddl = f"file_id bigint, image_id bigint, acquired_at {kind}, axis string, place string, rank int, value double, number string, unit string, nm bigint"
    return rows.mapInArrow(_readings, ddl)


def size_readings(files: DataFrame) -> DataFrame:
    """Every size of every file and axis, from all its places: file_id, image_id, acquired_at, axis, place, rank, value, number, unit.

    ``rank`` is the order of precedence, ``number`` the exact value as text,
    ``unit`` is null where no text gives one. Null, empty or unreadable texts
    offer nothing; sizes whose unit names no length (px, arb, ...) or that
    exceed BIGINT in nanometres are left out. Repeated rows count once. A table
    without image_id or acquired_at has nulls there.
    """
    return _all_readings(files).drop("nm").distinct()


def with_series(readings: DataFrame) -> DataFrame:
    """Readings with their series: the axis of an image; a file without an image is a series of its own."""
    image = F.coalesce(F.col("image_id").cast("string"), F.concat(F.lit("file "), F.coalesce(F.col("file_id").cast("string"), F.lit(""))))
    return readings.withColumn("series", F.concat_ws("/", image, "axis"))


def voxel_sizes(files: DataFrame) -> DataFrame:
    """One row per file and axis with a usable size: file_id, axis, size_nm.

    Of the places of a file the first usable one counts. Its unit is that of the
    text, or ``DEFAULT`` where the text is silent. No unit is left to decode, so
    neither the series nor the other files of an image have a say. No usable
    size, no row; repeated rows count once.
    """
    first = F.min_by("nm", F.struct("rank", "number", F.coalesce("unit", F.lit("")))).alias("size_nm")
    return _all_readings(files).groupBy("file_id", "axis").agg(first)


# --- hidden Markov model over the unit -------------------------------------

_NM = np.array([float(v) for v in NM.values()])
_LOG = np.log10(_NM)
_NEG = -1e18
_SHIFT = _LOG[None, :] - _LOG[:, None]
_STAY = 1 - np.eye(len(_LOG))


def _steps(jump: np.ndarray, sigma: float, switch: float) -> np.ndarray:
    """Log score of each state pair for each jump of the log value: the level in common units moves smoothly, a switch costs."""
    return -0.5 * ((jump[:, None, None] + _SHIFT) / sigma) ** 2 - switch * _STAY


def _emissions(known: np.ndarray) -> np.ndarray:
    """Log score of each state: 0, but for a known one (-1 for none) that no other state can have emitted."""
    return np.where((known[:, None] < 0) | (known[:, None] == np.arange(len(_LOG))), 0.0, _NEG)


def viterbi(y: np.ndarray, known: np.ndarray, lens: np.ndarray, prior: np.ndarray, last: np.ndarray, sigma: float, switch: float) -> np.ndarray:
    """The likeliest state of every reading of many series at once.

    ``y`` (log values) and ``known`` (states or -1) are flat, ``lens`` the
    length of each series, ``prior`` scores its first state, ``last`` fixes its
    final one (-1: free). All series take a step together, the longest last.
    """
    order = np.argsort(-lens, kind="stable")
    start = (np.cumsum(lens) - lens)[order]
    left = lens[order]
    score = prior[order] + _emissions(known[start])
    back = np.zeros((len(y), len(_LOG)), np.int8)
    n = len(left)
    for t in range(1, int(left[0]) if n else 0):
        n = int(np.searchsorted(-left, -t))  # series with a reading t
        at = start[:n] + t
        whole = score[:n, :, None] + _steps(y[at] - y[at - 1], sigma, switch)
        back[at] = whole.argmax(1)
        score[:n] = whole.max(1) + _emissions(known[at])
    out = np.empty(len(y), np.int8)
    state = np.where(last[order] >= 0, last[order], score.argmax(1))
    for t in range(int(left[0]) - 1 if len(left) else -1, -1, -1):
        n = int(np.searchsorted(-left, -t))
        at = start[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def _block_matrix(y: np.ndarray, known: np.ndarray, sigma: float, switch: float) -> np.ndarray:
    """Max-plus product of a block: best score from each first to each last state."""
    n = len(_LOG)
    m = np.where(np.eye(n, dtype=bool), _emissions(known[:1]), _NEG)
    for i in range(1, len(y)):
        m = (m[:, :, None] + _steps(y[i : i + 1] - y[i - 1 : i], sigma, switch)).max(1) + _emissions(known[i : i + 1])
    return np.maximum(m, _NEG)


def _states_of(units: pa.ChunkedArray, silent: int) -> np.ndarray:
    return pc.fill_null(pc.index_in(units, pa.array(STATES)), silent).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _decode_map(names: list[str], prior: np.ndarray, silent: int, sigma: float, switch: float, rows_at_once: int = 1 << 16):
    def decode(rows: pa.Table) -> pa.RecordBatch:
        new = np.ones(rows.num_rows, bool)
        for c in ("series", "part"):
            x = rows.column(c).combine_chunks()
            same = pc.equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same if c == "series" else new[1:] | ~same
        at = np.flatnonzero(new)
        first, last = (pc.fill_null(rows.column(c), -1).to_numpy()[at] for c in ("first", "last"))
        value = rows.column("value").to_numpy()
        begin = np.where(first[:, None] >= 0, np.where(np.arange(len(_LOG)) == first[:, None], 0.0, _NEG), prior)
        path = viterbi(np.log10(value), _states_of(rows.column("unit"), silent), np.diff(np.append(at, rows.num_rows)), begin, last, sigma, switch)
        cols = [*(rows.column(c).combine_chunks() for c in names), pa.array(STATES).take(pa.array(path)), pa.array(value * _NM[path])]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "state", "size_nm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < rows_at_once:
                continue
            rows = pa.Table.from_batches(held)
            series, part = rows.column("series").to_pylist(), rows.column("part").to_pylist()
            whole = rows.num_rows - 1  # the last block may go on in the next batch
            while whole and (series[whole - 1], part[whole - 1]) == (series[-1], part[-1]):
                whole -= 1
            if whole:
                yield decode(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield decode(pa.Table.from_batches(held))

    return run


def decode_units(
    readings: DataFrame,
    series: str = "series",
    at: str = "at",
    value: str = "value",
    unit: str = "unit",
    sigma: float = 0.05,
    switch: float = 8.0,
    default: str = DEFAULT,
    silent: str | None = None,
    keep: Sequence[str] = (),
    untimed: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Name the unit of every reading by the Viterbi path of its series.

    ``readings`` holds a series key, a time, a positive number and a unit name
    of ``STATES`` or null where none is recorded. Result: series, at, value,
    the columns of ``keep``, state, size_nm (double). Rows with null series, time
    or value, or a value that is not positive and finite, are not readings and
    are left out; with
    ``untimed`` null times stay and come last. Equal times are ordered by
    value. A unit in the text can come from its own state alone; a silent
    reading can come from any, or with ``silent`` from that one alone. A series
    that is silent throughout starts at ``default`` rather than elsewhere by a
    prior of one switch.

    The readings are range-partitioned by series and time (``parts`` of them,
    by default as the session has it), and all series of a partition are
    decoded together. A series that crosses partitions is reduced to a small
    max-plus matrix per partition; the matrices of a series are chained to fix
    the states at the borders, and its parts are then decoded like all others.
    No task holds more than a partition, or one matrix per part of a series.
    """
    n = len(STATES)
    kept = list(dict.fromkeys(keep))
    rows = readings.select(
        F.col(series).cast("string").alias("series"), F.col(at).alias("at"), F.col(value).cast("double").alias("value"), F.col(unit).cast("string").alias("unit"), *kept
    ).filter(f"series is not null and {'true' if untimed else 'at is not null'} and value > 0 and value < double('inf')")
    by = ["series", F.col("at").isNull(), "at", "value", *kept, "unit"]
    rows = rows.repartitionByRange(*([parts] if parts else []), *by)
    rows = materialize(rows.sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "readings")
    prior = np.where(np.arange(n) == STATES.index(default), 0.0, -switch)
    pinned = STATES.index(silent) if silent else -1

    def reduce_block(table: pa.Table) -> pa.Table:
        y = np.log10(table.column("value").to_numpy())
        m = _block_matrix(y, _states_of(table.column("unit"), pinned), sigma, switch)
        one = table.slice(0, 1).select(["series", "part"])
        return one.append_column("y0", pa.array(y[:1])).append_column("y1", pa.array(y[-1:])).append_column("m", pa.array([m.ravel().tolist()], pa.list_(pa.float64())))

    def chain(pdf):
        pdf = pdf.sort_values("part")
        scores, back, score, y_last = [], [], None, 0.0
        for r in pdf.itertuples():
            if score is None:
                start, came = prior, None
            else:
                into = score[:, None] + _steps(np.array([r.y0 - y_last]), sigma, switch)[0]
                start, came = into.max(0), into.argmax(0)
            whole = start[:, None] + np.array(r.m).reshape(n, n)
            scores.append(whole.argmax(0))
            back.append(came)
            score, y_last = whole.max(0), r.y1
        ends, firsts, s = [], [], int(score.argmax())
        for arg, came in zip(reversed(scores), reversed(back)):
            ends.append(s)
            firsts.append(f := int(arg[s]))
            s = int(came[f]) if came is not None else f
        return pdf[["series", "part"]].assign(first=firsts[::-1], last=ends[::-1])

    crossing = rows.groupBy("series").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a < _b").select("series")
    crossing = materialize(crossing, "crossing-series")  # fewer than partitions
    blocks = rows.join(small(crossing), "series", "left_semi")
    blocks = blocks.groupBy("series", "part").applyInArrow(_ordered(reduce_block, ["at", "value", *kept]), "series string, part int, y0 double, y1 double, m array<double>")
    borders = materialize(blocks.groupBy("series").applyInPandas(chain, "series string, part int, first int, last int"), "borders")
    whole = rows.join(small(borders), ["series", "part"], "left").repartition("part").sortWithinPartitions("part", *by)
    names = ["series", "at", "value", *keep]
    fields = [f"{c} {whole.schema[c].dataType.simpleString()}" for c in names] + ["state string", "size_nm double"]
    return whole.mapInArrow(_decode_map(names, prior, pinned, sigma, switch), ", ".join(fields))


def _ordered(f, by: Sequence[str]):
    """``f`` on the rows of a group in order, nulls last."""

    def run(table: pa.Table) -> pa.Table:
        return f(table.sort_by([(c, "ascending") for c in by]))

    return run
