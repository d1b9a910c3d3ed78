"""Addition aligned by dimension name.

Coordinates are never compared: alignment is by name and extent alone, and the
result carries neither coordinates nor attributes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import ArrayMeta, columns, merge_dims
from labelgrid.status import EINVAL, ESHAPE, SUCCESS, Slot, Status, report

#: Largest operand, in cells, that is broadcast to the other (24 bytes a cell at rank 4).
BROADCAST_CELLS = 250_000


def add(left: LabeledArray, right: LabeledArray, stat: Status | None = None) -> LabeledArray:
    """Sum over the union of the dimensions, named after ``left``; invalid and ESHAPE if a shared extent differs."""
    if not (left.valid() and right.valid()):
        report(stat, EINVAL, "an operand is invalid")
        return LabeledArray.invalid()
    merged = merge_dims(left.meta, right.meta)
    if merged is None:
        report(stat, ESHAPE, f"{left} and {right}")
        return LabeledArray.invalid()
    report(stat, SUCCESS)
    meta = ArrayMeta(left.name, *merged)
    out = columns(meta.rank)
    same = left.dims == right.dims
    if same and left._frame is not None and left._frame is right._frame:
        # Both are columns of one frame: a projection, no join.
        return LabeledArray(meta, left._frame.select(*out, (F.col(left._value) + F.col(right._value)).alias("value")))
    if same and meta.rank and left.chunks is not None and right.chunks is not None:
        return LabeledArray(meta, chunks=_add_chunks(left, right, out[1:], left.chunks is right.chunks))
    lefts = left.cells.toDF(*out[: left.rank()], "v_l")
    places = [out[meta.dims.index(d)] for d in right.dims]
    rights = right.cells.toDF(*places, "v_r")
    shared = [c for c, d in zip(places, right.dims) if d in left.dims]
    # A side goes to all executors only below a known cell count; shape is exact, so this is a proven bound.
    if right.size() <= BROADCAST_CELLS:
        rights = F.broadcast(rights)
    elif left.size() <= BROADCAST_CELLS:
        lefts = F.broadcast(lefts)
    joined = lefts.join(rights, shared) if shared else lefts.crossJoin(rights)
    return LabeledArray(meta, joined.select(*out, (F.col("v_l") + F.col("v_r")).alias("value")))


def _add_chunks(left, right, rest, one_frame):
    plus = lambda a, b: a + b
    if one_frame:
        return left.chunks.select(*rest, F.zip_with("chunk", "chunk", plus).alias("chunk"))
    lefts, rights = left.chunks.toDF(*rest, "c_l"), right.chunks.toDF(*rest, "c_r")
    joined = lefts.join(rights, rest) if rest else lefts.crossJoin(rights)
    return joined.select(*rest, F.zip_with("c_l", "c_r", plus).alias("chunk"))


def add_into(left: LabeledArray, right: LabeledArray, out: Slot, stat: Status | None = None) -> None:
    """``add`` into a destination, which stays as it was on failure.

    A destination that already held an array keeps that array's coordinates and
    attributes, even of dimensions that are gone; only cells, shape and name are new.
    """
    own = Status()
    result = add(left, right, own)
    if own.code == SUCCESS:
        out.array = result._with(coords=out.array.coords, attrs=out.array.attrs)
    report(stat, own.code, own.message)
