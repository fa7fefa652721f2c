"""Held-out test items that leak into a corpus: block-max WAND over a BM25 index of the items, then verification.

The test items are the index, the corpus is the stream of queries: every
document is cut into overlapping passages, and every item whose BM25 score
reaches the item's own threshold is a candidate. The terms are pairs of
neighbouring words: a run of words is a run of pairs, and pairs are far rarer
than words. The threshold of an item is the least score that any of its runs of
``run`` words can have, and the passage must share as many different pairs with
it as the least varied of its runs has, so a passage that holds such a run is
always retrieved.

The postings are walked item by item with pivots: the cursors of a passage's
pairs are kept in order of their items, the greatest weights are summed, and the
pairs counted, until the thresholds are reached, and all items before that
pivot are passed over. Items are numbered by their threshold, so the one of the
first cursor holds for all items to come, and grows on the way. Besides, a
block of items whose own greatest weights do not reach its threshold is passed
over as a whole. Many passages are walked in step, as rows of an array.
All bounds are exact, and no candidate is lost by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words of an item that make a leak.
RUN = 12
#: Items per block of the block maxima.
BLOCK = 16
#: Text of the items in one index, which every task holds; more items make several indexes, each searched by a pass over the corpus.
SHARD_BYTES = 4 << 20
#: Passages walked in step.
CHUNK = 1 << 13

_WORDS = re.compile(rb"[0-9a-z]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
#: Slack of the bounds against rounding in another order of summing.
_SLACK = 1e-9


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits, in lower case."""
    return _WORDS.findall((text or "").encode("utf-8", "replace").translate(_LOWER.tobytes()))


def _halves(low: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of words of a flat buffer as two numbers."""
    padded = np.zeros(len(low) + 24, dtype=np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray(len(low) + 16, dtype="<u8", buffer=padded, strides=(1,))
    return eight[start] & _MASK[np.minimum(lens, 8)], eight[start + 8 * (lens > 8)] & _MASK[np.clip(lens - 8, 0, 8)]


def _word_key(lo: np.ndarray, hi: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return lo * np.uint64(0x9E3779B97F4A7C15) + (hi ^ (lo >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + lens.astype(np.uint64) * np.uint64(0x165667B19E3779F9)


class Words:
    """Numbers of a set of words, looked up for whole arrays by binary search."""

    def __init__(self, words: list[bytes]):
        self.long = {w: i for i, w in enumerate(words) if len(w) > 16}
        ids = np.array([i for i, w in enumerate(words) if len(w) <= 16], dtype=np.int32)
        lens = np.array([len(words[i]) for i in ids], dtype=np.int64)
        low = np.frombuffer(b"".join(words[i] for i in ids), np.uint8)
        lo, hi = _halves(low, np.cumsum(lens) - lens, lens)
        # Words of one key stand in the dictionary instead.
        key, at, n = np.unique(_word_key(lo, hi, lens), return_index=True, return_counts=True)
        self.key, self.lo, self.hi, self.lens, self.ids = key, lo[at], hi[at], lens[at], ids[at]
        self.shared = {w: i for i, w in enumerate(words) if len(w) <= 16} if (n > 1).any() else {}

    def numbers(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word low[start : end], -1 for others."""
        out = np.full(len(start), -1, dtype=np.int32)
        lens = end - start
        if len(self.key):
            lo, hi = _halves(low, start, lens)
            at = np.minimum(np.searchsorted(self.key, _word_key(lo, hi, lens)), len(self.key) - 1)
            same = (self.lo[at] == lo) & (self.hi[at] == hi) & (self.lens[at] == lens)
            out[same] = self.ids[at[same]]
        for table, rest in ((self.long, np.flatnonzero(lens > 16)), (self.shared, np.flatnonzero((out < 0) & (lens <= 16)))):
            if table and len(rest):
                raw = low.tobytes()
                out[rest] = [table.get(raw[i:j], -1) for i, j in zip(start[rest].tolist(), end[rest].tolist())]
        return out


def _run_hash(words: np.ndarray) -> np.ndarray:
    """A hash of each row of words, in their order."""
    x = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        x = (x ^ words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


class ItemIndex:
    """An inverted index of the items with BM25 weights, thresholds and sparse block maxima.

    Items of fewer than ``run`` words hold no run and can not leak; null and
    empty items neither. Items of equal text leak together. Its size is linear
    in the words of the items. ``run`` is 2 or more.
    """

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, k1: float = 1.2, b: float = 0.75, block: int = BLOCK):
        if run < 2:
            raise ValueError("a run has two words or more")
        self.run, self.block = run, block
        kept = sorted({(i, tuple(w)) for i, t in items if i is not None and len(w := words_of(t)) >= run})
        self.item_ids = np.array([i for i, _ in kept], dtype=np.int64)
        self.n = n = len(kept)
        vocabulary = sorted({x for _, t in kept for x in t})
        self.words = Words(vocabulary)
        number = {w: i for i, w in enumerate(vocabulary)}
        lens = np.array([len(t) for _, t in kept], dtype=np.int64)
        self.tokens = np.fromiter((number[x] for _, t in kept for x in t), np.int32, int(lens.sum()))
        item = np.repeat(np.arange(n), lens)
        #: Sorted keys of the pairs; a pair's number is its place among them.
        near = np.flatnonzero(item[1:] == item[:-1])
        self.pair_keys, pair = np.unique(self.pair_key(self.tokens[near], self.tokens[near + 1]), return_inverse=True)
        #: pair * n + item of every posting, sorted.
        self.keys, of, tf = np.unique(pair.astype(np.int64) * max(n, 1) + item[near], return_inverse=True, return_counts=True)
        term, posted = np.divmod(self.keys, max(n, 1))
        df = np.bincount(term, minlength=len(self.pair_keys))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.maximum(lens - 1, 1)
        self.weights = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[posted] / size.mean())) if n else np.empty(0)
        # Every run of the items: its hash, the least score of each item's runs and the least number of different pairs.
        stop = np.cumsum(lens)
        begin = np.flatnonzero(np.arange(len(item)) + run <= stop[item]) if n else np.empty(0, np.int64)
        self.threshold, self.varied = np.full(n, np.inf), np.full(n, run)
        hashes = [np.empty(0, np.uint64)]
        for k in range(0, len(begin), 1 << 18):
            place = begin[k : k + (1 << 18), None] + np.arange(run)
            hashes.append(_run_hash(self.tokens[place]))
            # An item has one pair less than words, so pair and word numbers drift apart by one per item.
            posts = np.sort(of[(place - item[place])[:, :-1]], axis=1)
            first = np.ones(posts.shape, bool)
            first[:, 1:] = posts[:, 1:] != posts[:, :-1]
            np.minimum.at(self.threshold, item[place[:, 0]], (self.weights[posts] * first).sum(1))
            np.minimum.at(self.varied, item[place[:, 0]], first.sum(1))
        # Number the items by threshold.
        order = np.argsort(self.threshold, kind="stable")
        number_of = np.argsort(order)
        self.item_ids, self.threshold, self.varied = self.item_ids[order], self.threshold[order], self.varied[order]
        self.keys = term * max(n, 1) + number_of[posted] if n else self.keys
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        term, self.post_item = np.divmod(self.keys, max(n, 1))
        self.post_start = np.searchsorted(term, np.arange(len(self.pair_keys) + 1))
        self.most = np.zeros(len(self.pair_keys) + 1)  # the last is that of unknown pairs
        np.maximum.at(self.most, term, self.weights)
        self.n_blocks = -(-n // block)
        self.block_keys, at = np.unique(term * max(self.n_blocks, 1) + self.post_item // block, return_inverse=True)
        self.block_max = np.zeros(len(self.block_keys))
        np.maximum.at(self.block_max, at, self.weights)
        hashes = np.concatenate(hashes)
        order = np.lexsort((begin, hashes))
        self.run_hashes, self.run_begin = hashes[order], begin[order]
        self.run_item = number_of[item[self.run_begin]] if n else np.empty(0, np.int64)
        self.block_threshold = self.threshold[::block]
        self.block_varied = np.minimum.reduceat(self.varied, np.arange(0, n, block)) if n else np.empty(0, np.int64)
        #: The least of an item and all after it.
        self.varied_from = np.minimum.accumulate(self.varied[::-1])[::-1]
        self.least = self.threshold[0] if n else np.inf

    def pair_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b

    def pairs(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The number of the pair that begins at each coded word, -1 for unknown ones and across documents."""
        out = np.full(len(ids), -1, np.int64)
        at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & (doc[1:] == doc[:-1]))
        if len(at) and len(self.pair_keys):
            key = self.pair_key(ids[at], ids[at + 1])
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            held = self.pair_keys[place] == key
            out[at[held]] = place[held]
        return out

    def seek(self, pair: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first posting of each pair at ``item`` or later, and its item (``n`` past the last)."""
        at = np.searchsorted(self.keys, pair.astype(np.int64) * self.n + item)
        inside = at < self.post_start[pair + 1]
        return at, np.where(inside, self.post_item[np.minimum(at, len(self.keys) - 1)], self.n)

    def maximum(self, pair: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The greatest weight of each pair within a block, 0 where it has none."""
        key = pair.astype(np.int64) * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.block_keys, key), len(self.block_keys) - 1)
        return np.where(self.block_keys[at] == key, self.block_max[at], 0.0)


def code_words(index: ItemIndex, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number (or -1) and document of every word of a flat buffer; no word crosses documents."""
    low = _LOWER[b]
    inside = np.zeros(len(b) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[low]
    cut = np.zeros(len(b) + 1, dtype=bool)
    cut[offsets[:-1]] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return index.words.numbers(low, start, end), np.searchsorted(offsets, start, side="right") - 1


def leaks(index: ItemIndex, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of every leak among the coded words, each once."""
    run, found = index.run, [np.empty((0, 2), np.int64)]
    if index.n and len(ids) >= run:
        # Passages of 2 * run words at every run-th word of a document: each run of words lies in one of them.
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        length = np.diff(np.append(first, len(ids)))
        per_doc = np.maximum(1, -(-(length - run + 1) // run))
        begin = np.repeat(first, per_doc) + run * (np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
        stop = np.minimum(begin + 2 * run, np.repeat(first + length, per_doc))
        # A passage with too few known pairs, or whose greatest weights stay below every threshold, has no pivot at all.
        pair = index.pairs(ids, doc)
        total = np.concatenate([[0.0], np.cumsum(index.most[pair])])
        known = np.concatenate([[0], np.cumsum(pair >= 0)])
        last = stop - 1
        alive = (total[last] - total[begin]) * (1 + _SLACK) + 1e-6 >= index.least
        alive = np.flatnonzero(alive & (known[last] - known[begin] >= index.varied_from[0]))
        for at in range(0, len(alive), CHUNK):
            b, e = begin[alive[at : at + CHUNK]], stop[alive[at : at + CHUNK]]
            place = b[:, None] + np.arange(2 * run)
            at_ = np.minimum(place, len(ids) - 1)
            passage, item = candidates(index, np.where(place[:, :-1] < e[:, None] - 1, pair[at_[:, :-1]], -1))
            held = holds_run(index, np.where(place < e[:, None], ids[at_], -1), passage, item)
            found.append(np.stack([doc[b[passage[held]]], item[held]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], index.item_ids[pairs[:, 1]]


def candidates(index: ItemIndex, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of every item whose score, and number of pairs, reach its thresholds for a row of pairs, by block-max WAND.

    A row that is walked through falls out; the others go on to their next
    pivot together. Held at once: the cursors of the rows, nothing per item.
    """
    n, block = index.n, index.block
    # The pairs of a passage count once each.
    pair = np.sort(terms, axis=1)
    pair[:, 1:][pair[:, 1:] == pair[:, :-1]] = -1
    row = np.arange(len(pair))
    most = index.most[pair]  # -1 is the last, without weight
    cursor = np.full(pair.shape, n, dtype=np.int64)
    known = pair >= 0
    cursor[known] = index.seek(pair[known], np.zeros(known.sum(), np.int64))[1]
    rows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(row):
        order = np.argsort(cursor, axis=1)
        cursor, pair, most = (np.take_along_axis(x, order, 1) for x in (cursor, pair, most))
        first = np.minimum(cursor[:, 0], n - 1)
        reach = np.cumsum(most, axis=1) * (1 + _SLACK) + _SLACK >= index.threshold[first][:, None]
        reach &= (np.arange(1, pair.shape[1] + 1) >= index.varied_from[first][:, None]) & (cursor < n)
        on = reach.any(1)
        if not on.all():
            row, cursor, pair, most, reach = row[on], cursor[on], pair[on], most[on], reach[on]
            if not len(row):
                break
        pivot = cursor[np.arange(len(row)), reach.argmax(1)]
        before = cursor <= pivot[:, None]
        r, c = np.nonzero(before)
        most_here = index.maximum(pair[r, c], pivot[r] // block)
        bound, n_pairs = np.bincount(r, most_here, minlength=len(row)), np.bincount(r, most_here > 0, minlength=len(row))
        score = (bound * (1 + _SLACK) + _SLACK >= index.block_threshold[pivot // block]) & (n_pairs >= index.block_varied[pivot // block])
        # Where the block can not reach its threshold: on to the next block, or to the next pair's item before it.
        after = np.where(before, n, cursor).min(1)
        skip = np.minimum((pivot // block + 1) * block, after)
        # Else the score of the pivot, from the pairs that stand on it or come to it.
        at, item = index.seek(pair[r, c], np.where(score, pivot, skip)[r])
        hit = score[r] & (item == pivot[r])
        total, n_pairs = np.bincount(r[hit], index.weights[at[hit]], minlength=len(row)), np.bincount(r[hit], minlength=len(row))
        good = score & (total * (1 + _SLACK) + _SLACK >= index.threshold[pivot]) & (n_pairs >= index.varied[pivot])
        rows.append(row[good])
        items.append(pivot[good])
        # A pair on the pivot goes on to its next posting.
        step = at[hit] + 1
        item[hit] = np.where(step < index.post_start[pair[r, c][hit] + 1], index.post_item[np.minimum(step, len(index.keys) - 1)], n)
        cursor[r, c] = item
    return np.concatenate(rows), np.concatenate(items)


def holds_run(index: ItemIndex, text: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the passage of each candidate holds a run of its item, word by word."""
    out = np.zeros(len(passage), bool)
    for shift in range(text.shape[1] - index.run + 1):
        left = np.flatnonzero(~out)
        words = text[passage[left], shift : shift + index.run]
        left, words = left[(words >= 0).all(1)], words[(words >= 0).all(1)]
        h = _run_hash(words)
        lo, hi = np.searchsorted(index.run_hashes, h), np.searchsorted(index.run_hashes, h, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(left)), n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        mine = index.run_item[at] == item[left[which]]
        which, at = which[mine], at[mine]
        same = (index.tokens[index.run_begin[at][:, None] + np.arange(index.run)] == words[which]).all(1)
        out[left[which[same]]] = True
    return out


def leaked_items(documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key`` and item_id of every document that holds ``run`` consecutive words of an item.

    Null and empty texts hold nothing; repeated documents and items count once.
    The items are indexed in shards of about ``shard_bytes`` of text, however
    many there are; each index is broadcast and searched by one narrow map over
    the corpus. Only the leaks are shuffled, to drop repetitions.
    """
    rows = items.select("item_id", "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // shard_bytes))
    kind = documents.schema[key].dataType.simpleString()
    found = []
    for shard in range(shards):
        mine = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in mine.toLocalIterator()], run))
        found.append(documents.select(key, text).mapInArrow(_search_map(index, key), f"{key} {kind}, item_id bigint"))
    return reduce(DataFrame.unionByName, found).distinct()


def _search_map(index, key: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import slices, text_buffer

        for batch in batches:
            b, at = text_buffer(batch.column(1))
            for i, j in slices(at):
                ids, doc = code_words(index.value, b[at[i] : at[j]], at[i : j + 1] - at[i])
                docs, found = leaks(index.value, ids, doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs + i)), pa.array(found)], names=[key, "item_id"])

    return search
