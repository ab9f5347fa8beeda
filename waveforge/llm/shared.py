"""Small helpers the corpus operators share: shared storage, Arrow tasks and their memory."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: Rows of an Arrow batch between the JVM and Python, unless the session's owner has set another number.
BATCH_ROWS = 2048
_LOCAL: dict[str, str] = {}  # application id -> folder, only on local masters
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder for sessions inside one process (tests, local runs);
    on a cluster the setting is required, since executors don't see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="waveforge-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a lost executor costs only a re-read."""
    out, path = _written(df, name)
    if made := getattr(_OPEN, "made", None):
        made[-1].append(path)
    return out


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is materialized inside is removed at the end, but for what goes through the function that this yields."""
    if not hasattr(_OPEN, "made"):
        _OPEN.made = []
    _OPEN.made.append([])
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        kept.append(path)
        return out

    try:
        yield keep
    finally:
        made = _OPEN.made.pop()
        if _OPEN.made:
            _OPEN.made[-1].extend(kept)
        drop_folders(spark, made)


#: Rows (of some tens of bytes each) up to which a written table is broadcast; larger ones are shuffled to.
BROADCAST_ROWS = 100_000


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """A written table with the broadcast hint if it has at most ``BROADCAST_ROWS`` rows, so that texts don't move to it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integer_ids(df: DataFrame, *columns: str) -> None:
    """Raises unless the columns are integers: the operators that pack ids say so in place of casting texts."""
    for name in columns:
        if not isinstance(kind := df.schema[name].dataType, IntegralType):
            raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")


_HELD: dict = {}  # what a Python worker keeps between tasks of one operator: an encoder, a codec


def held(make: Callable, *args):
    """``make(*args)``, kept for the next task of the worker; only one such object is kept."""
    key = (make, args)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(*args)
    return _HELD[key]


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType, holds: bool = False) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size, giving memory back when a task ends.

    Workers outlive tasks: without that, what one stage has touched counts against the next one's executors.
    ``holds``: the function uses :func:`held`; other functions free what the worker still holds before they start.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            free_held()
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def free_held() -> None:
    _HELD.clear()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts in ``column`` hold about ``max_bytes`` together.

    A row larger than that forms a run by itself; no row is cut or left out.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held_bytes = 0
        for i, n in enumerate(sizes):
            if i > start and (held_bytes + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held_bytes = i, 0
            held_bytes += n
        yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20, max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Like :func:`slices`, but joins small batches up to the same bounds first: for tasks that pack what a run holds."""
    waiting, n_bytes, n_rows = [], 0, 0
    for part in slices(batches, column, max_bytes, max_rows):
        size = part.column(column).nbytes
        if waiting and (n_bytes + size > max_bytes or n_rows + part.num_rows > max_rows):
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n_bytes, n_rows = [], 0, 0
        waiting.append(part)
        n_bytes, n_rows = n_bytes + size, n_rows + part.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
