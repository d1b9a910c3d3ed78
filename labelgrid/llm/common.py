"""Small things that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text: repeated rows are one document, a NULL id is an id of its own."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-null-")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("-null-"))))


def per_worker(key: str, make):
    """``make()`` once per Python worker; shipped code is unpickled per task, so its globals don't last.

    A key's first word is its operator; workers serve one stage after the other, and what another operator kept goes.
    """
    kept = _drop_others(key.split()[0])
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _drop_others(operator: str) -> dict:
    kept = sys.__dict__.setdefault("_labelgrid_kept", {})
    for other in [k for k in kept if k.split()[0] != operator]:
        del kept[other]
    return kept


def release() -> None:
    """Gives memory that is free in this process back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def frugal(operator: str, run):
    """``run``, a function of batches, in a worker that drops what other operators kept before, and returns its free memory after.

    A worker outlives its task: it waits for the next one, of any stage, with all that it has not returned.
    """

    def whole(batches):
        _drop_others(operator)
        yield from run(batches)
        release()

    return whole


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; NULL is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
