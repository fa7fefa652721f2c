"""Long spans shared between records, by collinear chaining of shared k-mer seeds.

1. Seeds: every window of ``span`` characters of every text has a minimizer;
   the minimizers that occur in two texts are joined (``seed_pairs``). A seed
   stands for a run of windows; equal runs are one class, and each run is joined
   with witnesses of its windows instead of all partners, so that work is linear
   in the runs, however many texts share a seed, and no shared window is lost.
2. Chains: the joined seeds of two texts are chained in order, under a gap cost,
   through a Fenwick tree (``chain``).
3. Alignment: the text under each chain is fetched from both sides, and the
   seeds are extended on the characters themselves (``extended``). The verbatim
   pieces of ``span`` characters or more are the shared spans (``shared_chars``).

Fuzzy passages (``passages``) need all partners. Stretches of consecutive shared
seeds are classes with members (``stretches``); the classes are joined with each
other, chained, aligned, and the gaps between their pieces are the edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Materialized, materialize
from .winnow import Hashes, _mix, run_hash, seeds

SPAN = 240
#: Length of the k-mers that seed.
SEED = 48
#: Score lost per character of gap, on either side, between the pieces of a fuzzy passage.
GAP_COST = 0.5
#: The same between seeds: those of one verbatim piece lie at most span - seed characters apart and must stay chained.
SEED_GAP_COST = 0.1
#: Every common piece of so many characters seeds a fuzzy passage; shorter ones join it beside and between its pieces.
PIECE = 96
#: Characters without a shared seed that end a stretch.
REACH = 240
#: A seed with more different runs is matched by a distributed aggregation instead of within one task.
HOT_RUNS = 4096
#: Characters hashed together; a longer text is cut into parts that overlap by ``span`` - 1.
SLICE_CHARS = 2 << 20

_CLASS = ["h", "a", "n", "run"]
_SEED_SCHEMA = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("run", pa.int64())])
_SEED_DDL = "doc bigint, h bigint, pos bigint, a int, n int, run bigint"


def _chars(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _seed_map(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[int, int, str]] = []  # document, offset, text
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or text is None or len(text) < span:
                    continue
                for at in range(0, len(text) - span + 1, SLICE_CHARS):
                    piece = text[at : at + SLICE_CHARS + span - 1]
                    if size + len(piece) > 2 * SLICE_CHARS:
                        yield _seed_batch(parts, span, k)
                        parts, size = [], 0
                    parts.append((doc, at, piece))
                    size += len(piece)
            if parts:
                yield _seed_batch(parts, span, k)

    return run


def _seed_batch(parts: list[tuple[int, int, str]], span: int, k: int) -> pa.RecordBatch:
    lens = np.array([len(t) for _, _, t in parts], dtype=np.int64)
    stops = np.cumsum(lens)
    s = seeds(_chars([t for _, _, t in parts]), stops - lens, stops, span, k)
    doc, at = (np.array([p[i] for p in parts], dtype=np.int64)[s["text"]] for i in (0, 1))
    cols = [doc, s["h"], s["pos"] + at, s["pos"] - s["first"], s["last"] - s["first"], s["run"]]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, _SEED_SCHEMA)], schema=_SEED_SCHEMA)


_OUT = [("h", "bigint"), ("a", "int"), ("n", "int"), ("run", "bigint"), ("lo_doc", "bigint"), ("lo_pos", "bigint"), ("hi_doc", "bigint"), ("hi_pos", "bigint"), ("hot", "boolean")]
_OUT_DDL = ", ".join(f"{n} {t}" for n, t in _OUT)
_KEYS = [n for n, _ in _OUT]


def _context_map(span: int, rows_at_once: int = 8192):
    """The text of the runs of each document: text[pos - a : pos - a + n + span].

    Where several texts share a doc_id, a run is taken from the texts that hold it.
    """
    schema = pa.schema([*((n, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in _OUT), ("text", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        lens = np.array([len(r[-1]) for r in rows], dtype=np.int64)
        stop = np.cumsum(lens)
        held = run_hash(Hashes(_chars([r[-1] for r in rows])), stop - lens, stop) == np.array([r[_KEYS.index("run")] for r in rows])
        kept = [r for r, ok in zip(rows, held) if ok]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept) if kept else [[]] * len(schema), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in spots:
                    at = s["lo_pos"] - s["a"]
                    if text is not None and at + s["n"] + span <= len(text):
                        rows.append((*(s[k] for k in _KEYS), text[at : at + s["n"] + span]))
                    if len(rows) >= rows_at_once:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return run


def _grams(texts: list[str], n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and hash of every window of the texts; row i has n[i] + 1 windows."""
    count = n.astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    start = (np.cumsum(lens) - lens)[row] + offset
    return row, offset, _mix(Hashes(_chars(texts)).pieces(start, start + span), 0x9FB21C651E98DF25)


def _gram_map(span: int):
    """One row per window, for hot seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                row, offset, gram = _grams(part.column("text").to_pylist(), part.column("n").to_numpy(), span)
                cols = [part.column(c).take(pa.array(row)) for c in _KEYS[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(offset.astype(np.int32)), pa.array(gram.view(np.int64))], names=[*_KEYS[:-1], "o", "gram"])

    return run


_MATCH = ["h", "a", "n", "run", "w1_doc", "w1_pos", "w2_doc", "w2_pos", "r0", "r1"]
_MATCH_DDL = "h bigint, a int, n int, run bigint, w1_doc bigint, w1_pos bigint, w2_doc bigint, w2_pos bigint, r0 int, r1 int"


def _match_map(span: int, rows_at_once: int = 8192):
    """Match the runs of each seed window by window; the input is sorted by seed."""

    def match(rows: pa.Table) -> pa.RecordBatch:
        get = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in _KEYS[:-1]}
        row, offset, gram = _grams(rows.column("text").to_pylist(), get["n"], span)
        lo_order = np.lexsort((get["lo_pos"], get["lo_doc"]))
        hi_order = np.lexsort((get["hi_pos"], get["hi_doc"]))
        lo_rank, hi_rank = np.argsort(lo_order), np.argsort(hi_order)
        order = np.lexsort((gram, get["h"][row]))
        g, hs = gram[order], get["h"][row][order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (hs[1:] != hs[:-1])]))
        size = np.diff(np.append(first, len(g)))
        back = np.empty(len(g), np.int64)
        back[order] = np.repeat(np.arange(len(first)), size)
        lo = lo_order[np.minimum.reduceat(lo_rank[row[order]], first)][back]
        hi = hi_order[np.maximum.reduceat(hi_rank[row[order]], first)][back]
        doc = get["lo_doc"][row]
        use_lo, use_hi = get["lo_doc"][lo] != doc, get["hi_doc"][hi] != doc
        # A witness is the row's lower or higher representative: 2 * row or 2 * row + 1.
        witness = np.where(use_lo, 2 * lo, np.where(use_hi, 2 * hi + 1, -1))
        witness[(get["lo_doc"] != get["hi_doc"])[row]] = -1  # matched as a whole already
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (witness[1:] != witness[:-1])]))
        end = np.append(cut[1:], len(row)) - 1
        keep = witness[cut] >= 0
        cut, end = cut[keep], end[keep]
        w, r = witness[cut], row[cut]
        w_doc = np.where(w % 2 == 0, get["lo_doc"][w // 2], get["hi_doc"][w // 2])
        w_pos = np.where(w % 2 == 0, get["lo_pos"][w // 2], get["hi_pos"][w // 2])
        none = pa.nulls(len(r), pa.int64())
        cols = [*(pa.array(get[c][r]) for c in _CLASS), pa.array(w_doc), pa.array(w_pos), none, none]
        cols += [pa.array((offset[x] - get["a"][r]).astype(np.int32)) for x in (cut, end)]
        return pa.RecordBatch.from_arrays(cols, names=_MATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < rows_at_once:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last seed may go on in the next batch
            if whole:
                yield match(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield match(pa.Table.from_batches(held))

    return run


def shared_seeds(found: Materialized, unit: str, tag: str) -> DataFrame:
    """The seeds whose k-mer occurs in two units, written; ``found`` is dropped.

    The k-mers are written before the join, so that no aggregate stands between
    its shuffle and it, and a k-mer that a third of all texts hold is split.
    """
    shared = Materialized(found.df.groupBy("h").agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi")).filter("_lo <> _hi").select("h"), f"{tag}-keys")
    common = materialize(found.df.join(shared.df, "h", "left_semi"), tag)
    found.drop()
    shared.drop()
    return common


def seed_pairs(documents: DataFrame, span: int = SPAN, seed: int = SEED, hot_runs: int = HOT_RUNS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shared seeds of each document with witnesses: doc, pos, w_doc, w_pos.

    The k-mer at pos of doc stands at w_pos of w_doc, another document. For
    every window of ``span`` characters that another document holds, its
    minimizer is joined with a document that holds the whole window.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = Materialized(docs.mapInArrow(_seed_map(span, seed), _SEED_DDL), "seeds")
    common = shared_seeds(found, "doc", "shared-seeds")

    spot = F.struct("doc", "pos")
    runs = common.groupBy(*_CLASS).agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).select(
        *_CLASS, F.col("lo.doc").alias("lo_doc"), F.col("lo.pos").alias("lo_pos"), F.col("hi.doc").alias("hi_doc"), F.col("hi.pos").alias("hi_pos")
    )
    runs = materialize(runs, "runs")
    whole = runs.filter("lo_doc <> hi_doc").select(
        *_CLASS, F.col("lo_doc").alias("w1_doc"), F.col("lo_pos").alias("w1_pos"), F.col("hi_doc").alias("w2_doc"), F.col("hi_pos").alias("w2_pos"),
        (-F.col("a")).alias("r0"), (F.col("n") - F.col("a")).alias("r1"),
    )
    # Seeds with a run that is not matched as a whole, and another run to match it with.
    open_seeds = runs.groupBy("h").agg(F.count("*").alias("n_runs"), F.min(F.col("lo_doc") != F.col("hi_doc")).alias("all_whole"))
    open_seeds = open_seeds.filter("n_runs > 1 and not all_whole").select("h", (F.col("n_runs") > hot_runs).alias("hot"))
    spots = runs.join(open_seeds, "h").groupBy(F.col("lo_doc").alias("doc")).agg(F.collect_list(F.struct(*_KEYS)).alias("spots"))
    contexts = docs.join(spots, "doc").select("text", "spots").mapInArrow(_context_map(span), f"{_OUT_DDL}, text string")
    contexts = materialize(contexts, "contexts")
    ends = (
        contexts.filter("not hot")
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(_match_map(span), _MATCH_DDL)
    )
    grams = contexts.filter("hot").mapInArrow(_gram_map(span), f"{_OUT_DDL.replace(', hot boolean', '')}, o int, gram bigint")
    by_gram = grams.groupBy("h", "gram").agg(F.min(F.struct("lo_doc", "lo_pos")).alias("g_lo"), F.max(F.struct("hi_doc", "hi_pos")).alias("g_hi"))
    first = F.col("g_lo.lo_doc") != F.col("lo_doc")
    hot = grams.filter("lo_doc = hi_doc").join(by_gram, ["h", "gram"]).filter(first | (F.col("g_hi.hi_doc") != F.col("lo_doc"))).select(
        *_CLASS,
        F.when(first, F.col("g_lo.lo_doc")).otherwise(F.col("g_hi.hi_doc")).alias("w1_doc"),
        F.when(first, F.col("g_lo.lo_pos")).otherwise(F.col("g_hi.hi_pos")).alias("w1_pos"),
        F.lit(None).cast("bigint").alias("w2_doc"), F.lit(None).cast("bigint").alias("w2_pos"),
        (F.col("o") - F.col("a")).alias("r0"), (F.col("o") - F.col("a")).alias("r1"),
    )
    every = whole.unionByName(ends).unionByName(hot)
    other = F.col("w1_doc") != F.col("doc")
    return common.join(every.select(*_CLASS, "w1_doc", "w1_pos", "w2_doc", "w2_pos"), _CLASS).select(
        "doc", "pos", F.when(other, F.col("w1_doc")).otherwise(F.col("w2_doc")).alias("w_doc"), F.when(other, F.col("w1_pos")).otherwise(F.col("w2_pos")).alias("w_pos")
    )


class _Fenwick:
    """Prefix maxima: the best (score, block) over coordinates up to a place."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The best of the coordinates below ``i``."""
        top = (float("-inf"), -1)
        while i > 0:
            top = max(top, self.best[i])
            i -= i & -i
        return top


def blocks_of(matched: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, partner's start, length) of the maximal blocks, from matches that may overlap along a diagonal."""
    out: list[list[int]] = []
    for shift, start, stop in sorted((q - p, p, p + n) for p, q, n in matched):
        if out and out[-1][0] == shift and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([shift, start, stop])
    return [(s, s + d, e - s) for d, s, e in out]


def chain(blocks: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """Split blocks into collinear chains: (score, blocks in order), best first; every block is in one chain.

    The score of a chain is the length of its blocks less ``gap_cost`` for
    every character between them on either side.
    """
    if len(blocks) == 1:
        return [(float(blocks[0][2]), blocks)]
    n = len(blocks)
    stops = sorted({q + k for _, q, k in blocks})
    place = {y: i for i, y in enumerate(stops)}
    below = np.searchsorted(stops, [q for _, q, _ in blocks], side="right").tolist()
    tree = _Fenwick(len(stops))
    score, back = [0.0] * n, [-1] * n
    # Starts look up, stops put in; at equal places stops go first.
    events = sorted([(p, 1, i) for i, (p, _, _) in enumerate(blocks)] + [(p + k, 0, i) for i, (p, _, k) in enumerate(blocks)])
    for _, is_start, i in events:
        p, q, k = blocks[i]
        if is_start:
            best, j = tree.upto(below[i])
            gain = best - gap_cost * (p + q)
            score[i], back[i] = (k + gain, j) if j >= 0 and gain > 0 else (float(k), -1)
        else:
            tree.put(place[q + k], (score[i] + gap_cost * (p + q + 2 * k), i))
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        path, total = [], score[i]
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(blocks[i])
            i = back[i]
        if i >= 0:  # the rest belongs to a better chain
            total -= score[i] - gap_cost * (path[-1][0] + path[-1][1] - sum(blocks[i][:2]) - 2 * blocks[i][2])
        out.append((total, path[::-1]))
    return out


_CHAIN = [("doc", pa.int64()), ("w_doc", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64()), ("q0", pa.int64()), ("q1", pa.int64()), ("spots", pa.list_(pa.int64()))]
_CHAIN_DDL = "doc bigint, w_doc bigint, p0 bigint, p1 bigint, q0 bigint, q1 bigint, spots array<bigint>"


def _chain_map(seed: int, gap_cost: float, rows_at_once: int = 8192):
    """The chains of the seeds that two documents share; the input is sorted by both and place.

    A chain has the ranges of its seeds' starts on both sides and, as ``spots``,
    the offsets of the seeds from them, in turn.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(_CHAIN), _CHAIN)], names=[n for n, _ in _CHAIN])

    def chains(key: tuple[int, int], spots: list[tuple[int, int]]) -> Iterator[tuple]:
        for _, path in chained([(p, q, seed) for p, q in sorted(set(spots))], gap_cost):
            (p0, q0, _), (p1, q1, _) = path[0], path[-1]
            yield (*key, p0, p1, q0, q1, [x for p, q, _ in path for x in (p - p0, q - q0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spots, rows = None, [], []
        for batch in batches:
            for doc, w, p, q in zip(*(col.to_pylist() for col in batch.columns)):
                if (doc, w) != key:
                    if spots:
                        rows.extend(chains(key, spots))
                    key, spots = (doc, w), []
                    if len(rows) >= rows_at_once:
                        yield out(rows)
                        rows = []
                spots.append((p, q))
        if spots:
            rows.extend(chains(key, spots))
        yield out(rows)

    return run


def seed_chains(pairs: DataFrame, seed: int = SEED, gap_cost: float = SEED_GAP_COST) -> DataFrame:
    """Collinear chains of joined seeds: doc, w_doc, p0, p1, q0, q1, spots; every seed is in one chain."""
    rows = pairs.select("doc", "w_doc", "pos", "w_pos").repartition("doc", "w_doc").sortWithinPartitions("doc", "w_doc")
    return rows.mapInArrow(_chain_map(seed, gap_cost), _CHAIN_DDL)


def _align_map(span: int):
    """Verbatim pieces of ``span`` or more under each chain: doc, start, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for doc, p0, q0, a_from, b_from, spots, a, b in zip(*(col.to_pylist() for col in batch.columns)):
                dp, dq = p0 - a_from, q0 - b_from
                # Of several texts under one id only some hold the place.
                held = [(dp + x, dq + y) for x, y in zip(spots[::2], spots[1::2]) if dp + x < len(a) and dq + y < len(b)]
                for p, _, n in extended(a, b, held, span):
                    for col, v in zip(out, (doc, a_from + p, a_from + p + n)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "start", "stop"])

    return run


def verbatim_pieces(documents: DataFrame, chains: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Align chains on the text of both sides: doc, start, stop of the pieces of ``span`` or more that are equal, character by character.

    A verbatim piece reaches at most ``span`` characters beyond the first and
    the last of its seeds that lie in one window with its ends, so that much
    text is fetched around each chain.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("_d"), F.col(text).alias("_text")).dropna()
    chains = materialize(chains.withColumn("a_from", F.greatest(F.col("p0") - span, F.lit(0))).withColumn("b_from", F.greatest(F.col("q0") - span, F.lit(0))).withColumn("cid", F.monotonically_increasing_id()), "chains")
    cut = lambda start, last: F.substring("_text", (F.col(start) + 1).cast("int"), (F.col(last) - F.col(start) + 2 * span).cast("int"))
    left = docs.join(chains, F.col("_d") == F.col("doc")).select("cid", "doc", "p0", "q0", "a_from", "b_from", "spots", cut("a_from", "p1").alias("a"))
    right = docs.join(chains.select("cid", "w_doc", "b_from", "q1"), F.col("_d") == F.col("w_doc")).select("cid", cut("b_from", "q1").alias("b"))
    both = left.join(right, "cid").select("doc", "p0", "q0", "a_from", "b_from", "spots", "a", "b")
    return both.mapInArrow(_align_map(span), "doc bigint, start bigint, stop bigint")


def copies(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, rep_id, n_chars: each document with the least document that holds the same text.

    Documents that share an id have a row for each of their texts.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna()
    rows = docs.select("doc_id", F.sha2("text", 256).alias("_t"), F.length("text").cast("bigint").alias("n_chars")).distinct()
    reps = rows.groupBy("_t").agg(F.min("doc_id").alias("rep_id"))
    return rows.join(reps, "_t").select("doc_id", "rep_id", "n_chars")


_STRETCH = ["cid", "tid", "first", "stop", "h", "rel", "sub"]
_STRETCH_DDL = "cid bigint, tid bigint, first bigint, stop bigint, h bigint, rel bigint, sub bigint"


def _stretch_map(piece: int, k: int, reach: int, least: int):
    """Cut the shared seeds of each text, sorted by text and place, into stretches and name their classes.

    A stretch whose pieces could not hold ``least`` characters together is left
    out: common characters lie at most ``piece`` - ``k`` away from a seed.
    ``sub`` stands for the seed before and its distance, null without one
    within reach of a window.
    """

    def out(tid: np.ndarray, h: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        step = np.diff(pos, prepend=pos[:1])
        new = np.ones(len(pos), bool)
        new[1:] = (tid[1:] != tid[:-1]) | (step[1:] > reach)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pos)))
        held = np.where(new, 2 * piece - k, np.minimum(step, 2 * piece - k))
        whole = np.repeat(np.add.reduceat(held, first) >= least, size)
        rel = pos - np.repeat(pos[first], size)
        name = np.add.reduceat(_mix(h.view(np.uint64) ^ _mix(rel.astype(np.uint64) + np.uint64(1))), first).view(np.int64)
        sub = np.zeros(len(pos), np.uint64)
        sub[1:] = _mix(h[:-1].view(np.uint64) ^ _mix(step[1:].astype(np.uint64)))
        far = new | (step > piece - k + 1)
        stop = np.repeat(pos[first + size - 1] + k, size)
        cols = [np.repeat(name, size), tid, pos - rel, stop, h, rel]
        return pa.RecordBatch.from_arrays([*(pa.array(c[whole]) for c in cols), pa.array(sub.view(np.int64)[whole], mask=far[whole])], names=_STRETCH)

    def run(batches: Iterator[pa.RecordBatch], rows_at_once: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < rows_at_once:
                continue
            rows = pa.Table.from_batches(held)
            tid = rows.column("tid").to_numpy()
            whole = int(np.searchsorted(tid, tid[-1]))  # the last text may go on in the next batch
            if whole:
                yield out(*(rows.column(c).to_numpy()[:whole] for c in ("tid", "h", "pos")))
            held = rows.slice(whole).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield out(*(rows.column(c).to_numpy() for c in ("tid", "h", "pos")))

    return run


def distinct_texts(documents: DataFrame, least: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The different texts of ``least`` characters or more (tid, text, lo, hi: least and greatest document) and who holds them (doc, tid)."""
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).dropna().filter(F.length("text") >= least)
    tid = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("bigint").alias("tid")
    held = docs.groupBy(tid).agg(F.first("text").alias("text"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    return materialize(held, "texts"), docs.select("doc", tid).distinct()


def stretches(texts: DataFrame, piece: int = PIECE, reach: int = REACH, least: int = SPAN) -> DataFrame:
    """The stretches of shared seeds of every text, one row per seed: cid, tid, first, stop, h, rel, sub.

    A stretch is a row of seeds that other texts hold too, none more than
    ``reach`` after the one before. Stretches with the same seeds at the same
    distances have the same pieces and are one class, ``cid``; only a text
    between the pieces may differ. Every common piece of ``piece`` characters
    holds a seed.
    """
    # k-mers no shorter than the greatest distance of two minimizers: what lies between equal neighbours is equal.
    k = piece // 2 + 1
    found = Materialized(texts.select(F.col("tid").alias("doc"), "text").mapInArrow(_seed_map(piece, k), _SEED_DDL).select(F.col("doc").alias("tid"), "h", "pos").distinct(), "piece-seeds")
    common = shared_seeds(found, "tid", "shared-piece-seeds")
    rows = common.select("tid", "h", "pos").repartition("tid").sortWithinPartitions("tid", "pos")
    return materialize(rows.mapInArrow(_stretch_map(piece, k, reach, least), _STRETCH_DDL), "stretches")


def class_members(seeds: DataFrame, held: DataFrame) -> DataFrame:
    """class_id, doc_id, from_char, to_char, n_members of every stretch in every document that holds it; copies of a text are all there."""
    members = seeds.filter("rel = 0").select("cid", "tid", "first", "stop").distinct()
    rows = members.join(held, "tid").select(F.col("cid").alias("class_id"), F.col("doc").alias("doc_id"), F.col("first").alias("from_char"), F.col("stop").alias("to_char"))
    rows = materialize(rows.distinct(), "members")
    size = materialize(rows.groupBy("class_id").agg(F.count("*").alias("n_members")), "member-counts")
    return rows.join(size, "class_id")


def _same(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal from a[i] and b[j] on."""
    n, done, k, grow = min(len(a) - i, len(b) - j), 0, 64, True
    while done < n and k:
        k = min(k, n - done)
        if a[i + done : i + done + k] == b[j + done : j + done + k]:
            done += k
            k = 2 * k if grow else k
        else:
            k, grow = k // 2, False
    return done


def _same_before(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal just before a[i] and b[j]."""
    n, done, k, grow = min(i, j), 0, 16, True
    while done < n and k:
        k = min(k, n - done)
        if a[i - done - k : i - done] == b[j - done - k : j - done]:
            done += k
            k = 2 * k if grow else k
        else:
            k, grow = k // 2, False
    return done


def extended(a: str, b: str, spots: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """The maximal equal pieces of ``least`` characters or more around common places of two texts, in order."""
    seen: dict[int, int] = {}  # diagonal: the stop of its last piece
    out = []
    for i, j in sorted(spots):
        if i < seen.get(j - i, 0):
            continue
        back = _same_before(a, i, b, j)
        n = back + _same(a, i, b, j)
        seen[j - i] = i - back + n
        if n >= least:
            out.append((i - back, j - back, n))
    return sorted(out)


def chained(pieces: list[tuple[int, int, int]], gap_cost: float) -> Iterator[tuple[float, list[tuple[int, int, int]]]]:
    """``chain`` for pieces in order that may overlap on one side, as they do where an edit repeats the text beside it.

    The later piece is cut there to follow the earlier one, and is whole again where a chain starts with it.
    """
    cut, blocks, last = {}, [], None
    for p, q, n in pieces:
        over = max(last[0] + last[2] - p, last[1] + last[2] - q) if last and last[0] < p and last[1] < q else 0
        over = over if 0 < over < n else 0
        last = (p + over, q + over, n - over)
        cut[last] = max(over, cut.get(last, 0))
        blocks.append(last)
    for score, path in chain(blocks, gap_cost):
        (p, q, n), over = path[0], cut[path[0]]
        yield score + over, [(p - over, q - over, n + over), *path[1:]]


def alike(a: str, b: str) -> int:
    """Characters that an alignment of two texts matches at most: their longest common subsequence, by bits."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        u = free & at.get(c, 0)
        free = (free + u | free - u) & full
    return len(a) - free.bit_count()


def beyond(a: str, i: int, b: str, j: int, reach: int, gap_cost: float) -> list[tuple[int, int, int]]:
    """Shorter equal pieces that follow a[i] and b[j], each after an edit of less than ``reach`` that it outweighs."""
    out, least = [], max(4, reach // 4)
    while True:
        for x in range(i, min(i + reach, len(a) - least + 1)):
            y = b.find(a[x : x + least], j, j + reach + least)
            if y >= 0 and (n := _same(a, x, b, y)) > gap_cost * (x - i + y - j):
                break
        else:
            return out
        out.append((x, y, n))
        i, j = x + n, y + n


def widened(a: str, b: str, score: float, path: list[tuple[int, int, int]], reach: int, gap_cost: float) -> tuple[float, list[tuple[int, int, int]]]:
    """A chain with the shorter equal pieces beside its ends."""
    (p, q, _), (p2, q2, k) = path[0], path[-1]
    after = beyond(a, p2 + k, b, q2 + k, reach, gap_cost)
    before = [(p - x - n, q - y - n, n) for x, y, n in reversed(beyond(a[:p][::-1], 0, b[:q][::-1], 0, reach, gap_cost))]
    for side in ([*before, path[0]], [path[-1], *after]):
        for (x, y, n), (x2, y2, _) in zip(side, side[1:]):
            score -= gap_cost * (x2 - x - n + y2 - y - n)
    return score + sum(s[2] for s in before + after), before + path + after


_PASSAGE = {
    "doc_id": "bigint", "other_id": "bigint", "from_char": "bigint", "to_char": "bigint", "other_from": "bigint", "other_to": "bigint",
    "score": "double", "n_blocks": "int", "exact_chars": "bigint", "identity": "double", "class_id": "bigint", "other_class": "bigint",
}
_PASSAGE_DDL = ", ".join(f"{n} {t}" for n, t in _PASSAGE.items())
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _passage_map(shortest: int, gap_cost: float, least: int, rows_at_once: int = 20_000):
    """Passages of the pairs of each cell; its rows are sorted: the texts first, then the places by pair.

    Pieces have ``shortest`` characters or more, the pieces of a passage
    ``least`` together. Other members of a class may share up to ``shortest``
    characters more at either end of each piece, which counts for ``least``.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [[]] * len(_PASSAGE)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, _PASSAGE.values())], names=list(_PASSAGE))

    def pair(x: tuple, y: tuple, spots: list[tuple[int, int]]) -> Iterator[tuple]:
        (a, at, lo, hi, c), (b, at2, lo2, hi2, c2) = x, y
        # Texts of one document may be held by others too.
        doc, other = next(((d, o) for d in (lo, hi) for o in (lo2, hi2) if d != o), (None, None))
        blocks = extended(a, b, spots, shortest) if doc is not None else []
        if not blocks:
            return
        for score, path in chained(blocks, gap_cost):
            score, path = widened(a, b, score, path, shortest, gap_cost)
            (p, q, _), (p2, q2, k) = path[0], path[-1]
            exact = sum(s[2] for s in path)
            if exact + 2 * shortest * len(path) < least:
                continue
            same = exact + sum(alike(a[x + m : x2], b[y + m : y2]) for (x, y, m), (x2, y2, _) in zip(path, path[1:]))
            rest = (score, len(path), exact, same / max(p2 + k - p, q2 + k - q))
            here, there = (at + p, at + p2 + k), (at2 + q, at2 + q2 + k)
            yield (doc, other, *here, *there, *rest, c, c2)
            yield (other, doc, *there, *here, *rest, c2, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, texts, key, spots, rows = None, {}, None, [], []
        for batch in batches:
            for c, ta, tb, i, j, text, at, lo, hi, name in zip(*(col.to_pylist() for col in batch.columns)):
                if (ta, tb) != key or c != cell:
                    if spots:
                        rows.extend(pair(texts[key[0]], texts[key[1]], spots))
                    key, spots = (ta, tb), []
                    if len(rows) >= rows_at_once:
                        yield batch_of(rows)
                        rows = []
                if c != cell:
                    cell, texts = c, {}
                if text is not None:
                    texts[ta] = (text, at, lo, hi, name)
                else:
                    spots.append((i, j))
        if spots:
            rows.extend(pair(texts[key[0]], texts[key[1]], spots))
        yield batch_of(rows)

    return run


def passages(
    documents: DataFrame, span: int = SPAN, gap_cost: float = GAP_COST, piece: int = PIECE, reach: int = REACH, text: str = "text", key: str = "doc_id", cell_chars: int = 2 << 20
) -> DataFrame:
    """The fuzzy passages between classes of stretches, in both directions, whose members may share ``span`` verbatim characters or more.

    Columns: doc_id, other_id, from_char, to_char, other_from, other_to, score,
    n_blocks, exact_chars, identity (share of the longer side that is alike,
    in the pieces and in the alignment of the gaps between them), class_id,
    other_class. Each class speaks through its least text, and every other
    text of a class has a passage with that one; ``class_members`` names all
    documents of a class. Two documents share a passage if they are members of
    one class or of two classes with a passage.

    Every common piece of ``piece`` characters seeds. A place whose seed before
    is shared at the same distance too lies in a piece found from there, so
    each maximal common piece of two classes is joined once. Pieces are extended
    on the text and chained; shorter pieces beside a chain join it, and its gaps
    are aligned. Copies of a text are linked with the least document that
    holds it, which has their other links (``copies``).
    """
    texts, _ = distinct_texts(documents, piece, text, key)
    seeds = stretches(texts, piece, reach, span)
    # A class speaks through its least text; members with other text between the pieces are variants, aligned with that one.
    found = seeds.filter("rel = 0").select("cid", "tid", "first", "stop").join(texts, "tid").withColumn("v", F.xxhash64(F.expr("substring(text, int(first + 1), int(stop - first))")))
    found = found.groupBy("cid", "v").agg(F.min(F.struct("tid", "first", "stop")).alias("r")).select("cid", "v", "r.tid", "r.first", "r.stop")
    found = materialize(found, "variants")
    least = materialize(found.groupBy("cid").agg(F.min(F.struct("tid", "first")).alias("r")).select("cid", "r.tid", "r.first"), "classes")
    leads = least.select("cid", F.col("tid").alias("_t"), F.col("first").alias("_f"))
    found = found.join(leads, "cid").withColumn("lead", (F.col("tid") == F.col("_t")) & (F.col("first") == F.col("_f")))
    # The text of a variant with as much on either side as a piece may reach.
    start = F.greatest(F.col("first") - reach, F.lit(0))
    cut = F.substring("text", (start + 1).cast("int"), (F.col("stop") - start + reach).cast("int"))
    uid = F.when(F.col("lead"), F.col("cid")).otherwise(F.xxhash64("cid", "v"))
    units = materialize(found.join(texts, "tid").select(uid.alias("uid"), "cid", "lead", cut.alias("text"), start.alias("at"), (F.col("first") - start).alias("_in"), "lo", "hi"), "class-texts")
    own = materialize(seeds.join(least, ["cid", "tid", "first"], "left_semi").select("cid", "h", "sub", "rel", (F.col("rel") + F.least("first", F.lit(reach))).alias("pos")), "class-seeds")
    common = shared_seeds(Materialized(own.select("cid", "h", "sub", "pos"), "own-seeds"), "cid", "shared-class-seeds")

    chars = units.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(3, -(-chars // cell_chars))
    group = lambda c: F.pmod(F.col(c), F.lit(n))
    side = lambda x: common.select("h", F.col("cid").alias(f"u_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("sub").alias(f"sub_{x}"), group("cid").alias(f"g_{x}"))
    known = F.col("sub_a").eqNullSafe(F.col("sub_b")) & F.col("sub_a").isNotNull()
    pairs = side("a").join(side("b"), "h").filter((F.struct("g_a", "u_a") < F.struct("g_b", "u_b")) & ~known).select("g_a", "g_b", "u_a", "u_b", "pos_a", "pos_b")
    within = units.filter("not lead").select("cid", F.col("uid").alias("u_b"), group("uid").alias("g_b"), "_in").join(own.filter("sub is null"), "cid")
    within = within.select(group("cid").alias("g_a"), "g_b", F.col("cid").alias("u_a"), "u_b", F.col("pos").alias("pos_a"), (F.col("rel") + F.col("_in")).alias("pos_b"))
    pairs = materialize(pairs.unionByName(within).select((F.col("g_a") * n + F.col("g_b")).alias("cell"), "u_a", "u_b", "pos_a", "pos_b"), "places")
    used = pairs.select("cell", F.col("u_a").alias("uid")).union(pairs.select("cell", "u_b")).distinct()
    sent = used.join(units, "uid").selectExpr("cell", "uid AS u_a", "CAST(NULL AS bigint) AS u_b", "CAST(NULL AS bigint) AS pos_a", "CAST(NULL AS bigint) AS pos_b", "text", "at", "lo", "hi", "cid")
    rows = sent.unionByName(pairs, allowMissingColumns=True)
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("text").isNull(), "u_a", "u_b")
    linked = rows.mapInArrow(_passage_map(piece // 2, gap_cost, span), _PASSAGE_DDL)

    same = copies(documents, text, key).filter((F.col("doc_id") != F.col("rep_id")) & (F.col("n_chars") >= span))
    none = "CAST(NULL AS bigint)"
    for a, b in (("doc_id", "rep_id"), ("rep_id", "doc_id")):
        linked = linked.union(same.selectExpr(a, b, "0L", "n_chars", "0L", "n_chars", "double(n_chars)", "1", "n_chars", "1D", none, none))
    return linked


def passage_members(documents: DataFrame, span: int = SPAN, piece: int = PIECE, reach: int = REACH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The members of the classes that ``passages`` links: class_id, doc_id, from_char, to_char, n_members."""
    texts, held = distinct_texts(documents, piece, text, key)
    return class_members(stretches(texts, piece, reach, span), held)


def shared_chars(documents: DataFrame, span: int = SPAN, gap_cost: float = SEED_GAP_COST, seed: int = SEED, hot_runs: int = HOT_RUNS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the number of its characters in verbatim pieces of ``span`` or more that another document holds.

    The pieces come from the aligned chains of shared seeds. Documents that
    share nothing, null and short texts, and rows without a doc_id are left
    out; rows of one doc_id are one document. The characters are code points;
    those in several pieces count once.
    """
    chains = seed_chains(seed_pairs(documents, span, seed, hot_runs, text, key), seed, gap_cost)
    pieces = verbatim_pieces(documents, chains, span, text, key).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, upto = None, 0, 0
        for batch in batches:
            docs, sums = [], []
            for doc, start, stop in zip(*(col.to_pylist() for col in batch.columns)):
                if doc != at:
                    if at is not None:
                        docs.append(at)
                        sums.append(total)
                    at, total, upto = doc, 0, 0
                total += max(0, stop - max(start, upto))
                upto = max(upto, stop)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "shared_chars"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total], pa.int64())], names=["doc_id", "shared_chars"])

    return pieces.repartition("doc").sortWithinPartitions("doc", "start", "stop").mapInArrow(run, "doc_id bigint, shared_chars bigint")
