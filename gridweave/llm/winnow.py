"""Seeds of shared spans: minimizers of every window of a text, with exact hashes of what they stand for.

Every window of ``span`` characters has one minimizer, its k-mer of least hash
(the rightmost of equals), so two texts that share a window share its
minimizer at the same offset. A seed is a minimizer together with the run of
consecutive windows that chose it; the hash of the run's whole text tells
whether two runs stand verbatim in both texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POS = 24  #: bits of a position within a slice; slices are shorter than 2 ** 24 characters
_LOW = np.uint64((1 << _POS) - 1)
_ONE = np.uint64(1)


def _mix(x: np.ndarray, c: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Polynomial hashes of any piece of a text, from one running sum."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        self.up, self.down = _powers(1 << max(12, int(n).bit_length()))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)) * self.up[:n], out=self.sums[1:])

    def pieces(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def run_hash(hashes: Hashes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash that stands for the whole text of a run, wherever it stands."""
    return _mix(hashes.pieces(start, stop), 0x2127599BF4325C37).view(np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones."""
    n = len(x)
    rows = -(-n // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    block[:n] = x
    block = block.reshape(rows, w)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def seeds(chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, span: int, k: int) -> dict[str, np.ndarray]:
    """Seeds of the texts chars[start : stop] of one slice.

    Per seed: ``text`` (its index), ``h`` (hash of the k-mer), ``pos`` (of the
    k-mer in its text), ``first`` and ``last`` (the run of window starts) and
    ``run`` (hash of text[first : last + span]). Texts shorter than ``span``
    have none.
    """
    none = {c: np.empty(0, np.int64) for c in ("text", "h", "pos", "first", "last", "run")}
    if len(chars) < span:
        return none
    hashes = Hashes(chars)
    kmers = _mix(hashes.all(k))
    n_windows = len(chars) - span + 1
    place = np.arange(len(kmers), dtype=np.uint64)
    chosen = _LOW - (_sliding_min((kmers & ~_LOW) | (_LOW - place), span - k + 1) & _LOW)
    text = np.full(n_windows, -1, dtype=np.int64)
    count = np.maximum(0, stops - starts - span + 1)
    inside = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    text[inside] = np.repeat(np.arange(len(starts)), count)
    edge = np.empty(n_windows, dtype=bool)
    edge[0] = True
    edge[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n_windows) - 1
    keep = text[first] >= 0
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    t, pos = text[first], chosen[first].astype(np.int64)
    return {
        "text": t,
        "h": kmers[pos].view(np.int64),
        "pos": pos - starts[t],
        "first": first - starts[t],
        "last": last - starts[t],
        "run": run_hash(hashes, first, last + span),
    }
