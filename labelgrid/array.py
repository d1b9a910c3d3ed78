"""The labelled array: an immutable description over a frame of cells.

Two layouts hold the same cells.  *Cell rows* are ``d1 .. dr, value``.  *Chunk
rows* keep the fibre along the first dimension together as ``d2 .. dr,
chunk array<double>``: adding two of them joins one row per fibre, not per
cell.  ``cells`` is available from either.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.plans.meta import ArrayMeta, clean, columns
from labelgrid.status import EINVAL, SUCCESS, Status, report


class LabeledArray:
    """Immutable; every method returns a new array that shares the plan."""

    def __init__(self, meta: ArrayMeta | None, cells: DataFrame | None = None, *, frame: DataFrame | None = None, value: str = "value", chunks: DataFrame | None = None, source=None):
        """``frame``/``value``: a frame shared by several variables and this one's column in it; ``source``: the TableGrid it is of."""
        self._meta = meta or ArrayMeta()
        self._frame = frame if frame is not None else cells
        self._value = value
        self._chunks = chunks
        self._source = source
        self._ok = meta is not None and (self._frame is not None or chunks is not None)

    @classmethod
    def invalid(cls, meta: ArrayMeta | None = None) -> LabeledArray:
        out = cls(None)
        out._meta = meta or ArrayMeta()
        return out

    # -- description ---------------------------------------------------
    name = property(lambda self: self._meta.name)
    dims = property(lambda self: self._meta.dims)
    shape = property(lambda self: self._meta.shape)
    strides = property(lambda self: self._meta.strides)
    coords = property(lambda self: dict(self._meta.coords))
    attrs = property(lambda self: dict(self._meta.attrs))
    meta = property(lambda self: self._meta)
    chunks = property(lambda self: self._chunks)

    def valid(self, deep: bool = False) -> bool:
        """Shallow: no job.  Deep: one aggregate checks count, index ranges, distinct indices and NULLs."""
        if not self._ok or not self._meta.consistent():
            return False
        if not deep:
            return True
        cols, cells = columns(self._meta.rank), self.cells
        bad = F.col("value").isNull()
        for c, n in zip(cols, self.shape):
            bad = bad | F.col(c).isNull() | ~F.col(c).between(1, n)
        seen = cells.groupBy(*cols).agg(F.count("*").alias("n"), F.max(bad.cast("int")).alias("bad")) if cols else cells.select(F.lit(1).alias("n"), bad.cast("int").alias("bad"))
        row = seen.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.max("bad").alias("bad")).first()
        return (row.n or 0) == self._meta.cells == row["keys"] and not row.bad

    def size(self) -> int:
        return self._meta.cells if self.valid() else 0

    def rank(self) -> int:
        return self._meta.rank if self.valid() else -1

    def dim_index(self, name: str) -> int:
        return self._meta.axis(name) if self.valid() else 0

    # -- rows ----------------------------------------------------------
    @property
    def cells(self) -> DataFrame:
        """``d1 int .. dr int, value double``, one row per cell, in no order."""
        if not self._ok:
            raise ValueError("an invalid array has no cells")
        cols = columns(self._meta.rank)
        if self._frame is not None:
            return self._frame.select(*cols, F.col(self._value).alias("value"))
        return self._chunks.select(F.posexplode("chunk").alias("d0", "value"), *cols[1:]).select((F.col("d0") + 1).cast("int").alias("d1"), *cols[1:], "value")

    def chunked(self) -> LabeledArray:
        """The same array in chunk rows; one shuffle on ``d2 .. dr``."""
        if self._chunks is not None or not self.valid() or self._meta.rank == 0:
            return self
        rest = columns(self._meta.rank)[1:]
        fibre = F.transform(F.array_sort(F.collect_list(F.struct("d1", "value"))), lambda x: x["value"]).alias("chunk")
        return LabeledArray(self._meta, chunks=self.cells.groupBy(*rest).agg(fibre) if rest else self.cells.agg(fibre))

    def linear_index(self) -> Column:
        """1 + sum of (index - 1) * stride, as a long."""
        out = F.lit(1).cast("long")
        for c, step in zip(columns(self._meta.rank), self._meta.strides):
            out = out + (F.col(c).cast("long") - 1) * F.lit(step).cast("long")
        return out

    def values_df(self) -> DataFrame:
        """``lin long, value`` in linear order."""
        return self.cells.select(self.linear_index().alias("lin"), "value").orderBy("lin")

    def to_table(self, names: list[str] | None = None) -> DataFrame:
        """Cells under the dimensions' names, or ``names`` where those clash as columns."""
        names = list(names or self.dims)
        if len({n.lower() for n in [*names, "value"]}) != len(names) + 1:
            raise ValueError(f"{names} can't all be column names beside value; pass names=")
        return self.cells.toDF(*names, "value")

    def persist(self) -> LabeledArray:
        """Keep the cells for reuse (memory, then disk)."""
        return LabeledArray(self._meta, self.cells.persist()) if self._chunks is None else LabeledArray(self._meta, chunks=self._chunks.persist())

    # -- metadata ------------------------------------------------------
    def _with(self, **changes) -> LabeledArray:
        out = LabeledArray.__new__(LabeledArray)
        out.__dict__.update(self.__dict__)
        out._meta = replace(self._meta, **changes)
        return out

    def renamed(self, name: str) -> LabeledArray:
        return self._with(name=clean(name))

    def set_coord(self, name: str, values, stat: Status | None = None) -> LabeledArray:
        """Upsert the coordinate of a dimension; self unchanged and EINVAL if it doesn't fit.

        ``values``: numbers in index order, or a frame ``idx int, coord double``.
        """
        axis, n = self.dim_index(name), len(values) if hasattr(values, "__len__") else None
        if not axis:
            report(stat, EINVAL, f"no dimension {name!r}")
            return self
        if n is None:
            coord = values.select(F.col("idx").cast("int").alias("idx"), F.col("coord").cast("double").alias("coord"))
            n = coord.count()
        else:
            spark = (self._frame if self._frame is not None else self._chunks).sparkSession
            coord = coord_frame(spark, values)
        if n != self.shape[axis - 1]:
            report(stat, EINVAL, f"{n} coordinates for an extent of {self.shape[axis - 1]}")
            return self
        report(stat, SUCCESS)
        return self._with(coords=self.coords | {clean(name): coord})

    def set_attr(self, name: str, value: str) -> LabeledArray:
        """Upsert a text attribute; works on an invalid array too."""
        return self._with(attrs=self.attrs | {clean(name): value.rstrip(" ")})

    # -- operators -----------------------------------------------------
    def isel(self, dim, index, stat=None):
        from labelgrid.operators.select import isel

        return isel(self, dim, index, stat)

    def sel(self, dim, value, method=None, stat=None):
        from labelgrid.operators.select import sel

        return sel(self, dim, value, method, stat)

    def mean(self, dim, stat=None, ordered=False):
        from labelgrid.operators.reduce import mean

        return mean(self, dim, stat, ordered=ordered)

    def __add__(self, other):
        from labelgrid.operators.align import add

        return add(self, other) if isinstance(other, LabeledArray) else NotImplemented

    def __repr__(self):
        return f"LabeledArray({self.name!r}, {dict(zip(self.dims, self.shape))})" if self.valid() else "LabeledArray.invalid()"


def coord_frame(spark: SparkSession, values) -> DataFrame:
    rows = [(k, float(v)) for k, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "idx int, coord double")
