"""The shape of an image and of its tile grid; a small driver-side value."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from . import planner


@dataclass(frozen=True)
class ImageMeta:
    """Spatial axes (last fastest), extent, tile shape, halo and calibration of an image.

    ``axes`` are coordinate column names. Tiles are numbered in row-major
    order; the last tile of an axis may be clipped.
    """

    axes: tuple[str, ...]
    shape: tuple[int, ...]
    tile: tuple[int, ...]
    halo: tuple[int, ...] = ()
    scale: dict[str, float] = field(default_factory=dict)
    unit: str = "micrometer"

    def __post_init__(self):
        if not len(self.axes) == len(self.shape) == len(self.tile):
            raise ValueError("axes, shape and tile need the same length")
        if any(v <= 0 for v in (*self.shape, *self.tile)):
            raise ValueError("shape and tile must be positive")
        object.__setattr__(self, "halo", planner.normalize_overlap(self.halo or 0, len(self.axes), self.tile))

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // t) for s, t in zip(self.shape, self.tile))

    @property
    def n_tiles(self) -> int:
        return math.prod(self.grid)

    @staticmethod
    def _steps(shape: tuple[int, ...]) -> list[int]:
        return [math.prod(shape[i + 1 :]) for i in range(len(shape))]

    @property
    def tile_steps(self) -> list[int]:
        """Weight of each axis in a row-major tile number."""
        return self._steps(self.grid)

    @property
    def voxel_steps(self) -> list[int]:
        """Weight of each axis in a row-major voxel number."""
        return self._steps(self.shape)
