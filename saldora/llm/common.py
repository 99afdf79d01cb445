"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is exactly these six characters; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast after it was counted.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master that names none."""
    conf = spark.sparkContext.getConf()
    if given := conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    master = conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/saldora"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the right side only if it was counted and is small; else Spark shuffles both."""
    return left.join(F.broadcast(right) if fits(right, rows) else right.hint("merge"), on, how)


def drop_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped(__id); rows without an id stay."""
    return join_checked(docs, dropped, docs["doc_id"] == dropped["__id"], "left_anti")


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], total: int, how: str = "left") -> DataFrame:
    """rows joined to groups (one row a key, with its row count n); key columns are never null.

    Groups of over a two-thousandth of all rows, of which there are at most 2,000, are broadcast, so that no task
    gets all rows of such a group; the others are joined by key."""
    big = max(1000, total // 2000)
    hot, cold = F.broadcast(groups.where(F.col("n") > big)), groups.where(F.col("n") <= big)
    near = rows.join(hot, key)
    far = rows.join(hot.select(*key), key, "left_anti").join(cold, key, how)
    return near.unionByName(far.select(*near.columns))


def give_back() -> None:
    """Gives memory that is free in this process back to the system, so that workers which live on stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """run, a function of an iterator of Arrow batches, that gives free memory back at the end of each task."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def by_bytes(batch: pa.RecordBatch, column: int, size: int):
    """Slices of a batch whose texts hold about so many bytes together; a longer text is in one of its own or ends one."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = [0, *(np.flatnonzero(np.diff(held // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


_tools: dict = {}


def tool(key: tuple, make):
    """What make() gives, kept in the worker under key until another key is asked for: workers serve many operators one
    after the other, and each should have the memory to itself."""
    if key not in _tools:
        _tools.clear()
        give_back()
        _tools[key] = make()
    return _tools[key]
