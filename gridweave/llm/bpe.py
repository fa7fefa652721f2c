"""Encoding of texts with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The words of a whole batch are found by array operations on the UTF-8 bytes,
each different word is encoded once, and all words are merged together: their
symbols lie in one flat array, the rank of every adjacent pair is found by
binary search over the sorted pair keys, and each round merges the lowest pair
of every word. No Python loop runs over words or characters.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words of more bytes are merged one by one with a heap: many rounds would each pass over all of them.
LONG_WORD = 512
#: Bytes of text that are encoded together.
SLICE_BYTES = 16 << 20

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Code points with the White_Space property (fixed values).
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(_WHITE)] = _SPACE
    return out


def _byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge tables as arrays: sorted keys ``left << 32 | right``, their ranks and merged ids."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)  # by rank
        self.byte_ids = np.array([ids[c] for c in _byte_chars()], dtype=np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair by binary search, ``_NONE`` where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The rank of each pair key, made once per process and only where a long word comes."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one very long word, by a heap of pairs and a linked list."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank_of
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (q := rank.get(sym[x] << 32 | sym[y])) is not None:
                    heapq.heappush(heap, (q, x, sym[x], sym[y]))
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words at once; symbols flat, ``lens`` per word. Returns flat ids and their number per word."""
        words = np.arange(len(lens))
        done_words, done_lens, done_syms = [], [], []
        ends = np.cumsum(lens)
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        while len(words):
            starts = ends - lens
            least = np.minimum.reduceat(rank, starts)
            if (still := least != _NONE).sum() < len(words):
                keep = np.repeat(still, lens)
                done_words.append(words[~still])
                done_lens.append(lens[~still])
                done_syms.append(sym[~keep])
                words, lens, sym, rank, least = words[still], lens[still], sym[keep], rank[keep], least[still]
                if not len(words):
                    break
            hit = rank == np.repeat(least, lens)
            at = np.flatnonzero(hit)
            # Of overlapping equal pairs (a a a) the first, third ... of a run are merged.
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (np.diff(at) > 1) | (rank[at[1:]] != rank[at[:-1]])
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            word_of = np.repeat(np.arange(len(words)), lens)
            gone = np.bincount(word_of[at], minlength=len(words))
            lens = lens - gone
            ends = np.cumsum(lens)
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, rank = sym[keep], rank[keep]
            # Only pairs that touch a merged symbol have a new rank.
            for left in (at, at[at > 0] - 1):
                rank[left] = _NONE
                left = left[left < len(sym) - 1]
                rank[left] = self.rank(sym[left], sym[left + 1])
            rank[ends - 1] = _NONE
        if not done_words:
            return np.empty(0, np.int32), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(done_words))
        lens = np.concatenate(done_lens)
        flat = np.concatenate(done_syms)
        first = np.cumsum(lens) - lens
        return _gather(flat, first[order], lens[order]), lens[order]


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + len] one after another."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return flat[shift + np.arange(total)]


def split_words(b: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start offsets of the words of a flat UTF-8 buffer; no word crosses a document border.

    The words are those of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(b)
    table = _classes()
    kind = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        size = np.where(b[lead] >= 0xF0, 4, np.where(b[lead] >= 0xE0, 3, 2))
        at = lambda k: b[np.minimum(lead + k, n - 1)].astype(np.int32) & 0x3F
        head = b[lead].astype(np.int32)
        cp = np.where(
            size == 2, (head & 0x1F) << 6 | at(1), np.where(size == 3, (head & 0xF) << 12 | at(1) << 6 | at(2), (head & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3))
        )
        value = table[np.minimum(cp, 0x10FFFF)]
        for k in range(4):
            inside = (size > k) & (lead + k < n)
            kind[lead[inside] + k] = value[inside]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    begins = np.zeros(n + 1, dtype=bool)
    begins[doc_starts] = True
    start |= begins[:n]
    # A run of white space before other text gives its last character away: a
    # blank joins the next word, any other character stands alone.
    run = np.flatnonzero(start)
    stop = np.append(run[1:], n)
    white = (kind[run] == _SPACE) & ~begins[stop] & (stop < n)
    s, e = run[white], stop[white]
    if len(e):
        last = e - 1
        for _ in range(3):
            last = np.where((b[last] & 0xC0) == 0x80, last - 1, last)
        blank = b[last] == 0x20
        start[e[blank]] = False
        start[last[blank | (last > s)]] = True
    # Contractions.
    tick = np.flatnonzero((b == 0x27) & start)
    for k, nexts in ((1, (b"s", b"t", b"m", b"d")), (2, (b"re", b"ve", b"ll"))):
        t = tick[tick + k < n]
        ok = np.zeros(len(t), dtype=bool)
        for text in nexts:
            ok |= np.logical_and.reduce([b[t + 1 + i] == c for i, c in enumerate(text)])
        for i in range(k):
            ok &= ~begins[t + 1 + i]
        t = t[ok]
        start[t + 1] = False
        if k == 2:
            start[t + 2] = False
        t = t[t + k + 1 < n]
        start[t + k + 1] = True
    return np.flatnonzero(start)


def _distinct(b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Representative and class of equal words; exact."""
    padded = np.zeros(len(b) + 24, dtype=np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray(len(b) + 16, dtype="<u8", buffer=padded, strides=(1,))
    lo = eight[starts] & _MASK[np.minimum(lens, 8)]
    hi = eight[starts + 8 * (lens > 8)] & _MASK[np.clip(lens - 8, 0, 8)]
    key = lo * np.uint64(0x9E3779B97F4A7C15) + (hi ^ (lo >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + lens.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    long_ = np.flatnonzero(lens > 16)
    if len(long_):
        raw, known = b.tobytes(), {}
        tag = [known.setdefault(raw[i : i + k], j) for i, k, j in zip(starts[long_].tolist(), lens[long_].tolist(), long_.tolist())]
        lo[long_], hi[long_] = np.array(tag, dtype=np.uint64), 0
        key[long_] = lo[long_] * np.uint64(0xD6E8FEB86659FD93) + lens[long_].astype(np.uint64)
    _, rep, inv = np.unique(key, return_index=True, return_inverse=True)
    same = (lo[rep][inv] == lo) & (hi[rep][inv] == hi) & (lens[rep][inv] == lens)
    if not same.all():  # a collision of keys
        rows = np.stack([lo, hi, lens.astype(np.uint64)], axis=1)
        _, rep, inv = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return rep, inv.ravel()


def encode_flat(v: Vocabulary, b: np.ndarray, doc_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number per document of the documents b[offset[i] : offset[i + 1]]."""
    n_docs = len(doc_offsets) - 1
    if not len(b):
        return np.empty(0, np.int32), np.zeros(n_docs, np.int64)
    starts = split_words(b, doc_offsets[:-1])
    lens = np.diff(np.append(starts, len(b)))
    rep, inv = _distinct(b, starts, lens)
    w_lens = lens[rep]
    short = np.flatnonzero(w_lens <= LONG_WORD)
    flat, n_ids = v.merge(v.byte_ids[_gather(b, starts[rep[short]], w_lens[short])], w_lens[short])
    count = np.zeros(len(rep), np.int64)
    first = np.zeros(len(rep), np.int64)
    count[short], first[short] = n_ids, np.cumsum(n_ids) - n_ids
    extra, size = [flat], len(flat)
    for w in np.flatnonzero(w_lens > LONG_WORD):
        ids = v.merge_long(b[starts[rep[w]] : starts[rep[w]] + w_lens[w]].tobytes())
        count[w], first[w] = len(ids), size
        extra.append(ids)
        size += len(ids)
    flat = np.concatenate(extra)
    upto = np.concatenate([[0], np.cumsum(count[inv])])
    edges = upto[np.searchsorted(starts, doc_offsets)]
    return _gather(flat, first[inv], count[inv]), np.diff(edges)


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or not len(text):
        return np.empty(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def encode_texts(v: Vocabulary, text: pa.Array) -> pa.Array:
    b, at = text_buffer(text)
    flats, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for i, j in slices(at):
        flat, n = encode_flat(v, b[at[i] : at[j]], at[i : j + 1] - at[i])
        flats.append(flat)
        counts.append(n)
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats), pa.int32()))


def encode(documents: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ids (array of int) of every document, without special tokens.

    Null and empty texts have an empty list; strings of special tokens are
    ordinary text; repeated rows come out as often as they go in. The plan is
    one narrow map without a shuffle. The merge tables (under 1 MB, whatever
    the corpus) are broadcast once.
    """
    tables = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_texts(tables.value, batch.column(1))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
