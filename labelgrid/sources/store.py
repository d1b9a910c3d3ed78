"""Native store: a Parquet directory of cells (or chunks), coordinate directories, and the description as one JSON row."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelgrid.array import LabeledArray
from labelgrid.plans.meta import ArrayMeta, columns


def write_store(path: str, array: LabeledArray, partition_by: str | None = None) -> None:
    """Write an array; ``partition_by`` names a dimension whose index becomes the directory level (pruned by isel and sel)."""
    if not array.valid():
        raise ValueError("invalid array")
    meta = array.meta
    rows = array.cells if array.chunks is None else array.chunks
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(columns(meta.rank)[meta.axis(partition_by) - 1])
    writer.parquet(f"{path}/rows")
    for k, (_, coord) in enumerate(meta.coords.items()):
        coord.write.mode("overwrite").parquet(f"{path}/coord-{k}")
    about = {"name": meta.name, "dims": meta.dims, "shape": meta.shape, "attrs": meta.attrs, "coords": list(meta.coords), "chunks": array.chunks is not None}
    rows.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_store(spark: SparkSession, path: str) -> LabeledArray:
    about = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/meta").collect()))
    coords = {d: spark.read.parquet(f"{path}/coord-{k}") for k, d in enumerate(about["coords"])}
    meta = ArrayMeta(about["name"], tuple(about["dims"]), tuple(about["shape"]), coords, about["attrs"])
    kept = columns(meta.rank)
    rows = spark.read.parquet(f"{path}/rows")
    if about["chunks"]:
        return LabeledArray(meta, chunks=rows.select(*[F.col(c).cast("int") for c in kept[1:]], "chunk"))
    return LabeledArray(meta, rows.select(*[F.col(c).cast("int") for c in kept], "value"))
