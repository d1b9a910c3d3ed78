"""Selection of one index along one dimension.

``sel`` first resolves its label to an index with one small aggregate over the
coordinate.  The selection is then a literal predicate, which reaches the scan
as a pushed filter; a lazy join with the coordinate would not.  An array of a
table turns it into a filter on the table's key, below the aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import clean, columns
from labelgrid.status import EINVAL, ENOTFOUND, SUCCESS, Status, report


def isel(array: LabeledArray, dim: str, index: int, stat: Status | None = None) -> LabeledArray:
    """Keep index ``index`` (from 1) and drop the dimension; EINVAL if there is none."""
    axis = array.dim_index(dim)
    if not axis or not 1 <= index <= array.shape[axis - 1]:
        report(stat, EINVAL, f"no index {index} along {dim!r}")
        return LabeledArray.invalid()
    report(stat, SUCCESS)
    cols = columns(array.meta.rank)
    meta = array.meta.without(axis)
    grid = array._source.pick(axis, index) if array._source else None
    if grid:
        return LabeledArray(meta, frame=grid.frame, value=array._value, source=grid)
    if array.chunks is not None and axis > 1:
        kept = [c for k, c in enumerate(cols, 1) if k not in (1, axis)]
        rows = array.chunks.where(F.col(cols[axis - 1]) == index).select(*kept, "chunk")
        return LabeledArray(meta, chunks=rows.toDF(*columns(meta.rank)[1:], "chunk"))
    if array.chunks is not None:
        rows = array.chunks.select(*cols[1:], F.element_at("chunk", index).alias("value"))
        return LabeledArray(meta, rows.toDF(*columns(meta.rank), "value"))
    kept = [c for k, c in enumerate(cols, 1) if k != axis]
    rows = array.cells.where(F.col(cols[axis - 1]) == index).select(*kept, "value")
    return LabeledArray(meta, rows.toDF(*columns(meta.rank), "value"))


def resolve(coord, value: float, method: str | None) -> int | None:
    """Index of a label, by one aggregate: the first on ties; None for no match.

    ``nearest`` takes any distance.  NaN coordinates are farther than all
    others; a NaN label matches nothing exactly and the first index nearest.
    Any other ``method`` means exact, where NaN equals nothing.
    """
    if method is not None and clean(method) == "nearest":
        far = F.struct(F.abs(F.col("coord") - F.lit(float(value))), F.col("idx"))
        return coord.agg(F.min_by("idx", far).alias("at")).first().at
    if math.isnan(value):
        return None
    same = (F.col("coord") == F.lit(float(value))) & ~F.isnan("coord")
    return coord.where(same).agg(F.min("idx").alias("at")).first().at


def sel(array: LabeledArray, dim: str, value: float, method: str | None = None, stat: Status | None = None) -> LabeledArray:
    """``isel`` by coordinate; ENOTFOUND if the dimension, its coordinate or the label is missing."""
    axis = array.dim_index(dim)
    coord = array.meta.coords.get(clean(dim)) if axis else None
    at = None if coord is None else resolve(coord, float(value), method)
    if at is None:
        report(stat, ENOTFOUND, f"no {value!r} along {dim!r}")
        return LabeledArray.invalid()
    return isel(array, dim, at, stat)
