"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SCRATCH: list[list[str]] = []
CHUNK = 1 << 18
BROADCAST_BYTES = 16 << 20
#: Holds while tables are staged: shuffle files go when they are spent, and few whole texts are in a Python worker at once.
_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset and all runs in one process (tests), a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        base = _OWN[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.  The shuffle
    files of the write are not needed again, so Spark drops them when it ends."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    kept = {k: spark.conf.get(k) for k in _WRITES}
    for k, v in _WRITES.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those written by the function that this yields."""
    paths: list[str] = []
    _SCRATCH.append(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        path = paths.pop()
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(prefix: str, *taken: list[str]) -> str:
    """A column name that none of the lists holds, whatever the case of their letters."""
    used = {c.lower() for names in taken for c in names}
    return next(n for n in (f"{prefix}{i or ''}" for i in range(len(used) + 1)) if n.lower() not in used)


def named(column: str) -> Column:
    """The top-level column of this very name, dots and backticks and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def broadcast_if_small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A broadcast hint for a written table whose rows, of so many bytes each, are known to be few; otherwise Spark shuffles both sides."""
    total = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def lean(run: Callable) -> Callable:
    """A task's function that at its end hands freed memory back, as the worker lives on and the next stage has other needs."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def partition_id() -> int:
    return TaskContext.get().partitionId()


def text_chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each (one row at least)."""
    n = len(col)
    if n == 0:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def texts_of(col: pa.Array, at: int, to: int) -> list[str]:
    """Rows ``at:to`` as Python strings; null is the empty text."""
    return ["" if t is None else t for t in col.slice(at, to - at).to_pylist()]


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and its ``len + 1`` offsets, without a copy per row."""
    return bytes_buffer(pc.fill_null(col.cast(pa.large_string()), ""))


def bytes_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for a string or binary column without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
