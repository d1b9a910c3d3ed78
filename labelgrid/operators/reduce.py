"""Mean over one named dimension."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import columns
from labelgrid.status import EINVAL, ENOTFOUND, SUCCESS, Slot, Status, report


def mean(array: LabeledArray, dim: str, stat: Status | None = None, *, ordered: bool = False) -> LabeledArray:
    """Mean along ``dim``; the other dimensions keep their order, coordinates and the attributes.

    The default merges partial sums in any order.  ``ordered`` adds along the
    ascending index, which gives the same bits on every run: a running sum over
    the sorted fibre, which spills.  A reduced extent of 0 is EINVAL; other
    empty arrays stay empty and valid.
    """
    axis = array.dim_index(dim)
    if not axis:
        report(stat, ENOTFOUND, f"no dimension {dim!r}")
        return LabeledArray.invalid()
    extent = array.shape[axis - 1]
    if extent == 0:
        report(stat, EINVAL, f"{dim!r} is empty")
        return LabeledArray.invalid()
    report(stat, SUCCESS)
    cols, meta = columns(array.meta.rank), array.meta.without(axis)
    kept = [c for k, c in enumerate(cols, 1) if k != axis]
    if array.chunks is not None and axis == 1:  # the whole fibre is in the row: no shuffle at all
        total = F.aggregate("chunk", F.lit(0.0), lambda a, b: a + b)
        rows = array.chunks.select(*kept, (total / F.lit(float(extent))).alias("value"))
    elif ordered:
        along = Window.partitionBy(*kept).orderBy(cols[axis - 1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = array.cells.withColumn("value", F.sum("value").over(along))
        rows = running.where(F.col(cols[axis - 1]) == extent).select(*kept, (F.col("value") / F.lit(float(extent))).alias("value"))
    else:
        rows = (array.cells.groupBy(*kept) if kept else array.cells).agg(F.avg("value").alias("value"))
    return LabeledArray(meta, rows.toDF(*columns(meta.rank), "value"))


def mean_into(array: LabeledArray, dim: str, out: Slot, stat: Status | None = None, *, ordered: bool = False) -> None:
    """``mean`` into a destination, which stays as it was on failure."""
    own = Status()
    result = mean(array, dim, own, ordered=ordered)
    if own.code == SUCCESS:
        out.array = result
    report(stat, own.code, own.message)
