"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where none is set, a local session takes a temporary one and a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif spark.sparkContext.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="cairn-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as a table into the shared folder and reads it again.

    free: the shuffle files behind df, which nothing needs any more, are worth deleting at once.
    Spark deletes them when the driver's garbage collection finds them out of reach, which
    takes two collections: the first one lets go of what still holds them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for wait in (0.3, 0.3) if free else ():
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cairn_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_slices(batch: pa.RecordBatch, columns: tuple[str, ...] = ("doc_id", "text"), limit: int = SLICE_BYTES) -> Iterator[list[list]]:
    """The columns of a batch as lists, in runs of about `limit` bytes of the last column at most."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(cols[-1]), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield [c.slice(start, stop - start).to_pylist() for c in cols]
        start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups, about `limit` bytes or one group each, from rows in the order of a column of numbers."""
    held, size, wait = [], 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < wait:
            continue
        table = pa.Table.from_batches(held)
        last = held[-1].column(batch.schema.get_field_index(column))[-1].as_py()
        cut = int(np.searchsorted(table[column].to_numpy(), last))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
            wait = max(limit, 2 * size)
        else:
            # one group so far: looked at again when there is twice as much
            wait = 2 * size
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keeps numpy's matrix products to one thread a worker: tasks are what runs in parallel, and threads that wait for small products cost more than they bring."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as decimal text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def pieces(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
