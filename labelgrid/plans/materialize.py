"""Cutting a plan: write it to the folder that all executors share, read it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="labelgrid-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a frame that reads it.

    Unlike a local checkpoint the copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/labelgrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch():
    """Removes on leaving what ``materialize`` wrote inside, but for the frames put into the list that this gives.

    Those are up to the scratch around this one, if there is one.
    """
    written, kept = [], []
    _open.append(written)
    try:
        yield kept
    finally:
        _open.pop()
        if _open:
            _open[-1].extend(kept)
        left = {_root(f) for df in kept for f in df.inputFiles()}
        for df in written:
            if not {_root(f) for f in df.inputFiles()} & left:
                discard(df)


_open: list[list[DataFrame]] = []


def _root(file: str) -> str:
    return file.rsplit("/", 1)[0]


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    roots = {_root(f) for f in df.inputFiles()}
    for root in roots:
        if "/labelgrid/" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
