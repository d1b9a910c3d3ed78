"""What is known of an array without running a job.

Cells carry positional columns ``d1 .. dr`` and ``value``; dimension *names*
live here only.  Spark resolves columns without regard to case, so names such
as ``a`` and ``A`` (two dimensions here) can never be column names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any


def clean(name: str) -> str:
    """Names compare with trailing blanks ignored and case kept."""
    return name.rstrip(" ")


def columns(rank: int) -> list[str]:
    return [f"d{k}" for k in range(1, rank + 1)]


@dataclass(frozen=True)
class ArrayMeta:
    """Name, dimensions, extents, coordinates (dim -> frame of idx, coord) and attributes."""

    name: str = ""
    dims: tuple[str, ...] = ()
    shape: tuple[int, ...] = ()
    coords: dict[str, Any] = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def cells(self) -> int:
        return math.prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        """Steps of the linear index; the first dimension is the fastest."""
        return tuple(math.prod(self.shape[:k]) for k in range(self.rank))

    def axis(self, name: str) -> int:
        """Position of a dimension from 1, or 0."""
        name = clean(name)
        return self.dims.index(name) + 1 if name in self.dims else 0

    def without(self, axis: int) -> ArrayMeta:
        """The description after dimension ``axis`` (from 1) went."""
        gone = self.dims[axis - 1]
        return replace(
            self,
            dims=self.dims[: axis - 1] + self.dims[axis:],
            shape=self.shape[: axis - 1] + self.shape[axis:],
            coords={k: v for k, v in self.coords.items() if k != gone},
            attrs=dict(self.attrs),
        )

    def consistent(self) -> bool:
        return len(self.dims) == len(self.shape) and min(self.shape, default=0) >= 0 and len(set(self.dims)) == len(self.dims)


def merge_dims(left: ArrayMeta, right: ArrayMeta) -> tuple[tuple[str, ...], tuple[int, ...]] | None:
    """Union of the dimensions: the left ones, then what only the right has.

    None when a shared dimension has two extents; an extent of 1 is no wildcard.
    """
    extents = dict(zip(left.dims, left.shape))
    for dim, n in zip(right.dims, right.shape):
        if extents.setdefault(dim, n) != n:
            return None
    return tuple(extents), tuple(extents.values())
