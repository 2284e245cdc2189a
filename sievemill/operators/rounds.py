"""Tables that are written once and read back, for operators that go in rounds.

Unlike ``checkpoint()`` a write computes its plan once.  Files are in the folder that all executors share, survive lost
executors, and go when an operator has read them for the last time, or when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(spark.sparkContext, "_sievemill_rounds", None)
    if held is None:
        held = spark.sparkContext._sievemill_rounds = "file://" + tempfile.mkdtemp(prefix="sievemill-")
    return held


def _remove(path: str) -> None:
    spark = _left.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_left() -> None:
    for path in list(_left):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session may be gone
            continue


def new_folder(spark: SparkSession, name: str = "rounds") -> str:
    """The name of a folder that is not there yet; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, from files."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing will read again."""
    for df in tables:
        _remove(df.written_at)
