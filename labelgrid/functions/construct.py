"""Arrays from nested values, tables and array columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.array import LabeledArray
from labelgrid.dataset import Dataset
from labelgrid.plans.materialize import materialize
from labelgrid.plans.meta import ArrayMeta, clean, columns

MAX_RANK = 4
#: An axis with up to this many keys is numbered on the driver; a longer one is numbered by the executors.
AXIS_ON_DRIVER = 100_000


def data_array(spark: SparkSession, values, dims=(), name: str = "") -> LabeledArray:
    """Array of rank 0 to 4 from a number, nested lists or numpy; the values are copied.

    A wrong number of dimensions, a repeated one, rank above 4 or ragged lists give an invalid, unnamed array.
    """
    try:
        grid = np.array(values, dtype="float64")
    except (ValueError, TypeError):
        return LabeledArray.invalid()
    dims = tuple(clean(d) for d in ((dims,) if isinstance(dims, str) else dims))
    meta = ArrayMeta(clean(name), dims, tuple(grid.shape))
    if grid.ndim > MAX_RANK or not meta.consistent():
        return LabeledArray.invalid()
    flat = [float(x) for x in grid.ravel(order="F")]
    row = spark.createDataFrame([(flat,)], "v array<double>").select(F.posexplode("v").alias("p", "value"))
    index = [(F.expr(f"p div {step}") % n + 1).cast("int").alias(c) for c, n, step in zip(columns(meta.rank), meta.shape, meta.strides) if n] if meta.cells else [F.lit(1).alias(c) for c in columns(meta.rank)]
    return LabeledArray(meta, row.select(*index, "value"))


class Axis:
    """A dimension's sorted distinct keys: a frame of key (``k_<column>``) and index, their number, and the keys themselves if the driver has them."""

    def __init__(self, frame: DataFrame, size: int, keys: list | None = None):
        self.frame, self.size, self.keys = frame, size, keys
        self.field = frame.schema[0]

    @property
    def small(self) -> bool:
        return self.keys is not None

    def as_column(self, c: str) -> Axis:
        return Axis(self.frame.toDF(f"k_{c}", c), self.size, self.keys)


def _local_axis(spark: SparkSession, field: T.StructField, keys: set, c: str) -> Axis:
    ordered = sorted(keys)
    schema = T.StructType([T.StructField(f"k_{c}", field.dataType), T.StructField(c, T.IntegerType(), False)])
    return Axis(spark.createDataFrame([(v, k) for k, v in enumerate(ordered, 1)], schema), len(ordered), ordered)


def _number_axes(df: DataFrame, dims: list[str], cols: list[str]) -> list[Axis]:
    """All axes from one pass over the distinct key tuples, where those are few enough; else one by one."""
    if not dims:
        return []
    keys = df.select(*[F.col(f"`{d}`").alias(f"k_{c}") for d, c in zip(dims, cols)])
    tuples = keys.distinct().limit(AXIS_ON_DRIVER + 1).collect()
    if len(tuples) <= AXIS_ON_DRIVER:
        return [_local_axis(df.sparkSession, f, {t[k] for t in tuples} - {None}, c) for k, (f, c) in enumerate(zip(keys.schema, cols))]
    return [_number_axis(keys, c) for c in cols]


def _number_axis(keys: DataFrame, c: str) -> Axis:
    one = keys.select(f"k_{c}").where(F.col(f"k_{c}").isNotNull()).distinct()
    first = one.limit(AXIS_ON_DRIVER + 1).collect()
    if len(first) <= AXIS_ON_DRIVER:
        return _local_axis(keys.sparkSession, one.schema[0], {r[0] for r in first}, c)
    # Range-sorted parts are numbered apart; a part's offset is the rows before it.
    parts = materialize(one.orderBy(f"k_{c}").withColumn("part", F.spark_partition_id()), "axis")
    counts = parts.groupBy("part").count()
    offsets = counts.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(f"k_{c}")))
    out = ranked.join(F.broadcast(offsets), "part").select(f"k_{c}", (F.coalesce("before", F.lit(0)) + F.col("r")).cast("int").alias(c))
    return Axis(out, parts.count())


class TableGrid:
    """The grid that a table's facts give, and the way back: a selected key becomes a filter on the facts, below the aggregate.

    ``frame`` has a column per dimension (index) and ``v1 .. vn``, the aggregates.
    """

    def __init__(self, facts: DataFrame, dims: list[str], axes: list[Axis], values: list[Column], fill: float | None, picked: bool = False):
        self.facts, self.dims, self.axes, self.values, self.fill = facts, dims, axes, values, fill
        self._made: dict[tuple[int, int], TableGrid] = {}
        cols, names = columns(len(dims)), [f"v{k}" for k in range(1, len(values) + 1)]
        # Aggregate on the raw keys first: what joins with the axes is the grid, not the facts.
        keys = [F.col(f"`{d}`").alias(f"k_{c}") for d, c in zip(dims, cols)]
        sums = [v.cast("double").alias(n) for n, v in zip(names, values)]
        if dims:
            grid = facts.groupBy(*keys).agg(*sums)
        else:  # a selected cell without facts is no cell
            grid = facts.groupBy(F.lit(1).alias("one")).agg(*sums).drop("one") if picked else facts.agg(*sums)
        for axis, c in zip(axes, cols):
            grid = grid.join(F.broadcast(axis.frame) if axis.small else axis.frame, f"k_{c}")
        grid = grid.select(*cols, *names)
        if fill is not None and dims:
            full = reduce(lambda a, b: a.crossJoin(b), [F.broadcast(a.frame.select(c)) if a.small and k else a.frame.select(c) for k, (a, c) in enumerate(zip(axes, cols))])
            grid = full.join(grid, cols, "left").select(*cols, *[F.coalesce(n, F.lit(float(fill))).alias(n) for n in names])
        self.frame = grid

    def pick(self, axis: int, index: int) -> TableGrid | None:
        """The grid of one key of dimension ``axis`` (both from 1), the same object each time; None if the key isn't known here."""
        mine = self.axes[axis - 1]
        if not mine.small or (self.fill is not None and len(self.dims) == 1):
            return None
        if (axis, index) not in self._made:
            key = F.lit(mine.keys[index - 1]).cast(mine.field.dataType)
            rest = [k for k in range(len(self.dims)) if k != axis - 1]
            axes = [self.axes[k].as_column(c) for k, c in zip(rest, columns(len(rest)))]
            facts = self.facts.where(F.col(f"`{self.dims[axis - 1]}`") == key)
            self._made[axis, index] = TableGrid(facts, [self.dims[k] for k in rest], axes, self.values, self.fill, picked=True)
        return self._made[axis, index]


def variables_from_table(df: DataFrame, dims: list[str], values: dict[str, Column], fill: float | None = None) -> Dataset:
    """Several variables over one grid, as columns of one frame: adding two of them needs no join.

    Each dimension's index numbers the sorted distinct keys of its column (rows with a NULL key are left out);
    a numeric key is also the coordinate.  ``values`` are aggregates.  ``fill`` completes a sparse grid;
    with ``fill=None`` every key combination is expected to occur (``valid(deep=True)`` tells).
    """
    cols = columns(len(dims))
    axes = _number_axes(df, dims, cols)
    facts = df.where(reduce(lambda a, b: a & b, [F.col(f"`{d}`").isNotNull() for d in dims])) if dims else df
    grid = TableGrid(facts, list(dims), axes, list(values.values()), fill)
    coords = {}
    for dim, c, axis in zip(dims, cols, axes):
        if isinstance(axis.field.dataType, T.NumericType):
            coords[clean(dim)] = axis.frame.select(F.col(c).alias("idx"), F.col(f"k_{c}").cast("double").alias("coord"))
    out = Dataset()
    for n, key in enumerate(values, 1):
        meta = ArrayMeta(clean(key), tuple(clean(d) for d in dims), tuple(a.size for a in axes), dict(coords))
        out.set(key, LabeledArray(meta, frame=grid.frame, value=f"v{n}", source=grid) if meta.consistent() else LabeledArray.invalid())
    return out


def from_table(df: DataFrame, dims: list[str], value: Column, fill: float | None = None, name: str = "value") -> LabeledArray:
    """One variable of ``variables_from_table``."""
    return variables_from_table(df, dims, {name: value}, fill).get(name)


def from_array_column(df: DataFrame, key: str, column: str, extent: int, keys: int, dims=("component", "vec"), name: str = "") -> LabeledArray:
    """Rank 2 from an array column, kept in chunk rows: the position is the first index, ``key`` (dense from 0) the second.

    ``extent`` and ``keys`` state the two extents; rows are not checked here (``valid(deep=True)`` does).
    """
    rows = df.select((F.col(f"`{key}`") + 1).cast("int").alias("d2"), F.col(f"`{column}`").cast("array<double>").alias("chunk"))
    return LabeledArray(ArrayMeta(clean(name), tuple(clean(d) for d in dims), (extent, keys)), chunks=rows)

