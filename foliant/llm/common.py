"""Helpers shared by the training-data operators: shared storage, hot-key-safe lookups, code shipping.

Working tables go to the folder named by ``spark.checkpoint.dir`` so that they outlive any executor.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ship, work_dir

#: A key is hot when it holds more than 1/HOT_PARTS of all rows; there can be at most HOT_PARTS such keys.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    ship(spark)
    return work_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in the folder of this application, which ``session.forget`` removes."""
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: recovery restarts from these files."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """(filesystem, path without scheme) for a URI that executors can reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def lookup(left: DataFrame, right: DataFrame, key: str, values: list[str], count: str, total: int) -> DataFrame:
    """left LEFT JOIN right on key, safe when one key holds much of left.

    right has one row a key and in ``count`` the rows that left has for it. Keys with more than total/HOT_PARTS
    rows are at most HOT_PARTS many; they are broadcast, the others are joined by a shuffle.
    """
    least = max(1, total // HOT_PARTS)
    mark = "_hot_found"
    hot = right.where((F.col(count) > least) & F.col(key).isNotNull()).select(key, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias(mark))
    both = left.join(F.broadcast(hot), key, "left")
    warm = both.where(F.col(mark)).select(*left.columns, *[F.col(f"_hot_{v}").alias(v) for v in values])
    cold = both.where(F.col(mark).isNull()).select(*left.columns)
    rest = right.where((F.col(count) <= least) & F.col(key).isNotNull()).select(key, *values)
    return warm.unionByName(cold.join(rest, key, "left").select(*left.columns, *values))


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Partitions for compute-heavy steps over rows: at least one wave of the cluster when there is work for it."""
    return max(1, min(max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task)), -(-rows // 64) or 1))


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, .. so that no name of a user can clash, and the new names of some columns.

    A column is found by its exact name, else by its name in any case.
    """
    found = []
    for n in names:
        at = [k for k, c in enumerate(docs.columns) if c == n] or [k for k, c in enumerate(docs.columns) if c.lower() == n.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {n}")
        found.append(f"c{at[0]}")
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), found


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of docs, whatever the others are called."""
    flat, found = numbered(docs, *names)
    return flat.select(*[F.col(c).alias(n) for c, n in zip(found, names)])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


_held: dict = {}


def held(key, make):
    """make() for key, kept in this worker process until another key is asked for: one operator's cache at a time."""
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """Ends the cache of the operator before."""
    if _held:
        _held.clear()
        release()


def release() -> None:
    """Gives freed memory back to the system, which the worker's next operator and the executor's other worker need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def keep_memory() -> None:
    """Lets this worker keep what it frees until ``release``: arrays made anew for every chunk then cost no page faults."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except OSError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices in which a column of texts holds about ``most`` bytes, a longer text alone; then memory is given back."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, upto - at)
            at = upto
    release()
