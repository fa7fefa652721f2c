"""NumPy kernels that run on one dense tile."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import partial

import numpy as np


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least one it is linked with by the edges (a, b).

    The greater root is hooked under the lesser, and pointers jump until they
    stand on roots, until no edge joins two roots.
    """
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def connected_components(mask: np.ndarray, connectivity: str = "face") -> np.ndarray:
    """Components numbered 1..n by their first voxel in row-major order; ``face`` or ``full`` adjacency."""
    out = np.zeros(mask.shape, dtype=np.int64)
    place = np.flatnonzero(mask)
    if not len(place):
        return out
    number = np.full(mask.shape, -1, dtype=np.int64)
    number.ravel()[place] = np.arange(len(place))
    ends = []
    for step in itertools.product((0, 1, -1), repeat=mask.ndim):
        first = next((s for s in step if s), 0)
        if first <= 0 or (connectivity == "face" and sum(map(abs, step)) > 1):
            continue
        near = number[tuple(slice(0, -1) if s > 0 else slice(1, None) if s < 0 else slice(None) for s in step)]
        far = number[tuple(slice(1, None) if s > 0 else slice(0, -1) if s < 0 else slice(None) for s in step)]
        both = (near >= 0) & (far >= 0)
        ends.append((near[both], far[both]))
    a, b = (np.concatenate(x) for x in zip(*ends)) if ends else (np.empty(0, np.int64),) * 2
    root = least_linked(a, b, len(place))
    out.ravel()[place] = np.unique(root, return_inverse=True)[1] + 1
    return out


def dense_rank(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered 1..n by value; background stays 0."""
    values = np.unique(labels[labels > 0])
    return np.where(labels > 0, np.searchsorted(values, labels) + 1, 0)


def otsu(values: np.ndarray) -> float:
    """The value that splits best into two classes, by the variance between them; a constant sample gives 0."""
    v, n = np.unique(np.asarray(values).ravel(), return_counts=True)
    if len(v) < 2:
        return 0.0
    below = np.cumsum(n)[:-1].astype(float)
    above = n.sum() - below
    s = np.cumsum(v * n.astype(float))
    return float(v[:-1][np.argmax(below * above * (s[:-1] / below - (s[-1] - s[:-1]) / above) ** 2)])


def threshold_label(tile: np.ndarray, threshold: float | None = None, connectivity: str = "full") -> np.ndarray:
    """Components above a threshold; by default the tile's own Otsu value (0 for a constant tile)."""
    return connected_components(tile > (otsu(tile) if threshold is None else threshold), connectivity)


def _along(a: np.ndarray, axis: int, step: int) -> np.ndarray:
    """``a`` shifted along an axis, with zeros coming in."""
    out = np.zeros_like(a)
    if abs(step) < a.shape[axis]:
        move = [slice(None)] * a.ndim
        come = [slice(None)] * a.ndim
        move[axis], come[axis] = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
        out[tuple(move)] = a[tuple(come)]
    return out


def dilate(labels: np.ndarray, iterations: int = 1) -> np.ndarray:
    """Grow labels by a box of side 2 * iterations + 1; where grown labels collide the larger one wins."""
    for axis in range(labels.ndim):
        grown = labels
        for k in range(1, iterations + 1):
            grown = np.maximum(grown, np.maximum(_along(labels, axis, k), _along(labels, axis, -k)))
        labels = grown
    return labels


def _dilated(fn: Callable, iterations: int, tile: np.ndarray, *args, **kwargs) -> np.ndarray:
    return dilate(np.asarray(fn(tile, *args, **kwargs)), iterations)


def dilate_labels(fn: Callable, iterations: int = 1) -> Callable:
    """``fn`` with its labels grown before the halo is cut off; ``fn`` itself for no iterations."""
    return fn if iterations <= 0 else partial(_dilated, fn, iterations)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian in double precision, mirrored at the edges."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in range(a.ndim):
        padded = np.pad(a.astype(float), [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
        a = np.apply_along_axis(np.convolve, axis, padded, w, "valid")
    return a


def dog_label(tile: np.ndarray, low_sigma: float = 1.0, high_sigma: float = 4.0, threshold: float = 0.01) -> np.ndarray:
    """Components where the difference of two Gaussians exceeds a threshold."""
    x = tile.astype(np.float32)
    return connected_components(gaussian(x, low_sigma) - gaussian(x, high_sigma) > threshold).astype(np.int32)


def dog_label_fn(low_sigma: float = 1.0, high_sigma: float = 4.0, threshold: float = 0.01) -> Callable:
    return partial(dog_label, low_sigma=low_sigma, high_sigma=high_sigma, threshold=threshold)


def restore_shape(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Crop the centre and pad by the edge to a wanted shape."""
    for axis, want in enumerate(shape):
        extra = a.shape[axis] - want
        if extra > 0:
            a = np.take(a, range(extra // 2, extra // 2 + want), axis)
        elif extra < 0:
            before = -extra // 2
            a = np.pad(a, [(before, -extra - before) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    return a


def decon_voxel_args(voxel: dict[str, float], psf: dict[str, float] | None = None) -> dict[str, float]:
    """Pixel spacings of image and point-spread function for a deconvolution routine."""
    psf = psf or voxel
    return {"dxdata": voxel["x"], "dzdata": voxel["z"], "dxpsf": psf["x"], "dzpsf": psf["z"]}


def is_out_of_memory(error: BaseException) -> bool:
    text = str(error).lower()
    return isinstance(error, MemoryError) or "out of memory" in text or "alloc_failed" in text


def retry_on_oom(call: Callable, retries: int = 4, backoff: float = 30.0, on_release: Callable | None = None, sleep: Callable | None = None):
    """Call again after memory ran out, waiting longer each time; other errors pass through."""
    import time

    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if not is_out_of_memory(e) or attempt == retries:
                raise
            if on_release:
                on_release()
            (sleep or time.sleep)(backoff * (attempt + 1))


def channel_label(tile: np.ndarray, threshold: float = 0.0, channel_axis: int = 0) -> np.ndarray:
    """Components of face neighbours where the channels of a tile add up to more than a threshold."""
    return connected_components(tile.sum(axis=channel_axis) > threshold)


def model_fn(load: Callable, key: str, predict: str = "__call__", do_3d: bool = True, channel_axis: int | None = None, retries: int = 0, backoff: float = 30.0, **kwargs) -> Callable:
    """A tile function backed by a model that each worker process loads once per ``key``.

    ``predict`` names the model's method; what it returns first, if it returns
    several things, are the labels. Without ``do_3d`` a tile must have one
    plane along z. When memory runs out the model is let go and loaded again
    before up to ``retries`` further tries.
    """
    return partial(_predict, load, key, predict, do_3d, channel_axis, retries, backoff, kwargs)


_MODELS: dict[str, object] = {}


def drop_models() -> None:
    """Let go of the models of this process and of what they hold."""
    import gc

    _MODELS.clear()
    gc.collect()


def _predict(load: Callable, key: str, predict: str, do_3d: bool, channel_axis: int | None, retries: int, backoff: float, kwargs: dict, tile: np.ndarray) -> np.ndarray:
    spatial = [n for i, n in enumerate(tile.shape) if i != channel_axis]
    flat = not do_3d and len(spatial) == 3
    if flat and spatial[0] > 1:
        raise ValueError(f"a tile has {spatial[0]} planes; give tiles of one plane, or do_3d")
    if flat:  # the model sees a plane
        z = 1 if channel_axis == 0 else 0
        tile = tile.squeeze(z)
        if channel_axis is not None and channel_axis > z:
            channel_axis -= 1
    more = kwargs | ({"channel_axis": channel_axis} if channel_axis is not None else {})

    def call():
        if key not in _MODELS:
            _MODELS[key] = load()
        return getattr(_MODELS[key], predict)(tile, **more)

    out = retry_on_oom(call, retries, backoff, drop_models)
    labels = np.asarray(out[0] if isinstance(out, tuple) else out)
    return labels[None] if flat else labels
