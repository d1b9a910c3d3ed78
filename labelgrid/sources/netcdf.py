"""NetCDF classic as a Spark data source, and the two functions over it.

Reading is parallel: the driver parses the header, each task seeks to its range
of cells.  So is writing: cells and coordinates are dealt by their place in the
file, each task sorts its range and writes a part, and the commit puts header and
parts together, a buffer at a time; the file takes its place by a rename.
"""

from __future__ import annotations

import sys
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import ArrayMeta, clean, columns
from labelgrid.sources import classic
from labelgrid.status import EINVAL, SUCCESS, Status, report

MAX_RANK = 4
#: Cells a task reads or writes, and bytes copied at a time.
SLAB_CELLS, BUFFER = 4_000_000, 8 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(classic)


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI that the driver and all executors can open."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class _Slab(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _SlabReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable = path, variable

    def header(self):
        fs, name = locate(self.path)
        with fs.open_input_file(name) as f:
            return classic.read_header(f)

    def partitions(self):
        cells = int(np.prod(self.header().variables[self.variable].shape, dtype="int64"))
        return [_Slab(k, min(SLAB_CELLS, cells - k)) for k in range(0, cells, SLAB_CELLS)] or [_Slab(0, 0)]

    def read(self, partition):
        header = self.header()
        shape = header.variables[self.variable].shape[::-1]
        fs, name = locate(self.path)
        with fs.open_input_file(name) as f:
            flat = classic.read_cells(f, header, self.variable, partition.first, partition.count)
        for at in range(0, len(flat), 1_000_000):
            part = flat[at : at + 1_000_000]
            lin = partition.first + at + np.arange(len(part), dtype="int64")
            out, step = [], 1
            for n in shape:
                out.append(pa.array((lin // step % n + 1).astype("int32")))
                step *= n
            yield pa.record_batch([*out, pa.array(part)], names=[*columns(len(shape)), "value"])


class _Written(WriterCommitMessage):
    def __init__(self, part: str, first: int, cells: int):
        self.part, self.first, self.cells = part, first, cells


class _FileWriter(DataSourceArrowWriter):
    """Receives ``lin, value`` in order, a range of places a task; the header comes as an option."""

    def __init__(self, path: str, head: bytes, cells: int):
        self.path, self.head, self.cells, self.folder = path, head, cells, f"{path}.part-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, folder = locate(self.folder)
        part, first, cells = f"{folder}/{uuid.uuid4().hex}", -1, 0
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(part) as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                lin, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lin", "value"))
                first = int(lin[0]) if first < 0 else first
                if lin[0] != first + cells or (np.diff(lin) != 1).any():
                    raise ValueError("cells are missing or repeated")
                f.write(values.astype(">f8").tobytes())
                cells += len(values)
        return _Written(part, first, cells)

    def commit(self, messages):
        fs, folder = locate(self.folder)
        _, path = locate(self.path)
        whole, at = f"{folder}/whole", 0
        with fs.open_output_stream(whole) as out:
            out.write(self.head)
            for m in sorted((m for m in messages if m and m.cells), key=lambda m: m.first):
                if m.first != at:
                    raise ValueError("cells are missing or repeated")
                at += m.cells
                with fs.open_input_stream(m.part) as f:
                    while data := f.read(BUFFER):
                        out.write(data)
        if at != self.cells:
            raise ValueError(f"{at} cells for {self.cells} places")
        fs.move(whole, path)
        fs.delete_dir(folder)

    def abort(self, messages):
        fs, folder = locate(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class ClassicSource(DataSource):
    """``spark.read.format("netcdf_classic").option("variable", ...).load(path)``."""

    @classmethod
    def name(cls):
        return "netcdf_classic"

    def schema(self):
        rank = len(_SlabReader(self.options["path"], "").header().variables[self.options["variable"]].shape)
        return ", ".join([*(f"{c} int" for c in columns(rank)), "value double"])

    def reader(self, schema):
        return _SlabReader(self.options["path"], self.options["variable"])

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], bytes.fromhex(self.options["head"]), int(self.options["cells"]))


def read_netcdf(spark: SparkSession, filename: str, variable: str, stat: Status | None = None) -> LabeledArray:
    """One numeric variable of rank 0 to 4 with its coordinates, as float64; EINVAL on any failure.

    Dimensions come in array order, the reverse of the file's.  A coordinate is a 1-d variable named
    like its dimension and over it.  Attributes are not read, nor are fill values or scale factors applied.
    """
    spark.dataSource.register(ClassicSource)
    try:
        header = _SlabReader(filename, variable).header()
        v = header.variables[variable]
        if len(v.shape) > MAX_RANK or v.kind not in classic.NUMERIC:
            raise classic.FormatError("rank or type")
        dims, shape = tuple(clean(d) for d in v.dims[::-1]), tuple(v.shape[::-1])
        fs, name = locate(filename)
        size, coords = fs.get_file_info(name).size, {}
        for d in [variable, *v.dims[::-1]]:
            c = header.variables.get(d)
            if d != variable and (c is None or c.dims != [d] or c.kind not in classic.NUMERIC):
                continue
            if classic.end_of(header, d) > size:
                raise classic.FormatError("truncated")
        for d in v.dims[::-1]:
            c = header.variables.get(d)
            if c is not None and c.dims == [d] and c.kind in classic.NUMERIC:
                rows = spark.read.format("netcdf_classic").option("variable", d).load(filename)
                coords[clean(d)] = rows.select(F.col("d1").alias("idx"), F.col("value").alias("coord"))
    except (OSError, KeyError, ValueError, UnicodeDecodeError) as e:
        report(stat, EINVAL, str(e))
        return LabeledArray.invalid()
    meta = ArrayMeta(clean(variable), dims, shape, coords)
    if not meta.consistent():
        report(stat, EINVAL, "repeated dimension")
        return LabeledArray.invalid()
    report(stat, SUCCESS)
    return LabeledArray(meta, spark.read.format("netcdf_classic").option("variable", variable).load(filename))


def write_netcdf(filename: str, array: LabeledArray, stat: Status | None = None) -> None:
    """One array with its coordinates and text attributes; replaces the file, EINVAL on any failure.

    Refused before the file is touched: an invalid or unnamed array, a name equal to a dimension with a
    coordinate, an empty dimension other than the slowest.
    """
    meta = array.meta
    if not array.valid() or not meta.name or (meta.name in meta.dims and meta.name in meta.coords):
        report(stat, EINVAL, "invalid, unnamed, or named like a coordinate")
        return
    try:
        coords = [d for d in meta.dims if d in meta.coords]
        head, _ = classic.build_header(meta.name, list(meta.dims), list(meta.shape), meta.attrs, coords)
        spark = array.cells.sparkSession
        spark.dataSource.register(ClassicSource)
        at, rows = 0, []  # every number's place after the header: the coordinates, then the array
        for d in coords:
            rows.append(meta.coords[d].select((F.col("idx").cast("long") - 1 + at).alias("lin"), F.col("coord").alias("value")))
            at += meta.shape[meta.dims.index(d)]
        rows.append(array.cells.select((array.linear_index() - 1 + at).alias("lin"), F.col("value")))
        cells = at + meta.cells
        dealt = reduce(DataFrame.union, rows).repartitionById(max(1, -(-cells // SLAB_CELLS)), F.expr(f"cast(lin div {SLAB_CELLS} as int)"))
        sink = dealt.sortWithinPartitions("lin").write.format("netcdf_classic").mode("append")
        sink.option("head", head.hex()).option("cells", cells).save(filename)
    except Exception as e:  # noqa: BLE001 - the interface reports every failure as EINVAL
        report(stat, EINVAL, str(e)[:300])
        return
    report(stat, SUCCESS)
