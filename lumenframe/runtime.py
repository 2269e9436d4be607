"""Session helpers: ships this package to the executors once per Spark context; scratch folders, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share; it goes when the session ends.

    Where the session names no folder, a local master gets one of its own; any other master raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/core"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read again: later steps neither redo the work nor lose it with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: np.ndarray, most: int):
    """``(lo, hi)`` ranges of rows of about ``most`` bytes, one row at least."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def give_back() -> None:
    """Return freed memory to the system: idle Python workers live on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` whose worker gives its freed memory back when a task ends."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)
