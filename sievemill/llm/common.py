"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text, and rows, that one step of a Python operator holds at a time.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder is made.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(spark.sparkContext, "_sievemill_dir", None)
    if held is None:
        held = spark.sparkContext._sievemill_dir = "file://" + tempfile.mkdtemp(prefix="sievemill-")
    return held


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            continue


atexit.register(_remove_written)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Unlike ``checkpoint()`` it computes the plan once.  Files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    # what the finished step shuffled is no longer needed: lets the driver's cleaner find it
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Within it, what is computed goes to Python workers in batches of so many rows: both sides hold one for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)
        _written.remove((df.sparkSession, df.written_to))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of the column ``text`` each, one row at least, SLICE_ROWS at most."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths + 64) // size
    cuts = np.union1d(np.flatnonzero(np.diff(part)) + 1, np.arange(SLICE_ROWS, batch.num_rows, SLICE_ROWS))
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


_held: list = []
#: What else modules keep in a worker, to be emptied when room is needed.
_stores: list[dict] = []


def kept_in_worker(store: dict) -> dict:
    _stores.append(store)
    return store


def held(owner, make: Callable):
    """What ``make`` gives for ``owner``, kept in this worker until another owner comes or :func:`release` is called."""
    if not _held or _held[0] is not owner:
        _held[:] = [owner, make(owner)]
    return _held[1]


def release() -> None:
    _held.clear()
    for store in _stores:
        store.clear()


def release_everywhere(spark: SparkSession) -> None:
    """Lets the workers of all executors drop what they keep, before one of them needs room.

    As many tasks as there are cores run at the same time, so that each worker gets one.  Only memory depends on it.
    """
    n = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        gc.collect()
        give_back()
        time.sleep(0.5)
        yield from batches

    spark.range(0, n, 1, n).mapInArrow(run, "id long").count()


def give_back() -> None:
    """Hand memory that a finished task has freed back to the system: workers idle between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of an operator that keeps nothing in its workers, and needs the room of what others have kept."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        give_back()

    return df.mapInArrow(alone, schema)


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, size):
                yield f(part)
        give_back()

    return df.mapInArrow(run, schema)


def hash_bucket(column: str, seed: int = 17):
    """A stable number from 0 to 999,999 for a row, from the text form of a column (null counts as a value)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("\0")), F.lit(seed)), F.lit(1_000_000))


def windows(text: str, key: Column, chars: int, n: int) -> Column:
    """The text, or of one longer than ``n`` stretches of ``chars`` so many, placed by a hash of ``key`` and cut at blanks."""
    c = F.col(text)
    size = F.length(c)
    parts = []
    for i in range(n):
        start = F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(size - chars + 1, F.lit(1))) + 1
        parts.append(F.regexp_replace(c.substr(start.cast("int"), F.lit(chars)), r"^\S+\s|\s\S+$", ""))
    return F.when(c.isNull() | (size <= chars * n), c).otherwise(F.concat_ws(" ", *parts))


def fitted(rows: DataFrame, fit: Callable[[list[tuple]], object]):
    """What ``fit`` makes of all of a bounded table's rows, in one task; None if that gives nothing."""
    release_everywhere(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ = [tuple(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if held_:
            data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(fit(held_)))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["model"])

    got = map_arrow(rows.repartition(1), run, "model binary").collect()
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(got[0]["model"]))) if got else None


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash (ignoring case) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = name
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out
