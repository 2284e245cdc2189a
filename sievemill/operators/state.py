"""Steps of earlier runs: rows are only added, the latest of a key holds, and a step is reused only for the same finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Fixed value: bytes of a payload beyond which it is not kept.
MOST_BYTES = 104_857_600


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a zero byte; a null part is empty."""
    zero = F.lit(b"\x00")
    return F.sha2(F.concat(*[x for p in parts for x in (F.encode(F.coalesce(p.cast("string"), F.lit("")), "UTF-8"), zero)]), 256)


def latest(saved: DataFrame) -> DataFrame:
    """(run_id, step, payload, size) that hold: of each key the row saved last (``seq``); larger payloads were never saved."""
    fits = saved.withColumn("size", F.octet_length("payload").cast("long")).where(F.col("size") <= MOST_BYTES)
    return fits.groupBy("run_id", "step").agg(F.max_by(F.struct("payload", "size"), "seq").alias("_x")).select("run_id", "step", "_x.*")


def save(rows: DataFrame, folder: str) -> None:
    """Adds rows (run_id, step, payload, seq) as Parquet under their run; null keys and too large payloads are not kept."""
    rows.where((F.octet_length("payload") <= MOST_BYTES) & F.col("run_id").isNotNull() & F.col("step").isNotNull()).write.partitionBy("run_id").mode("append").parquet(folder)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        # names of input files are written as URIs
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_SAVED = "run_id string, step string, payload string, seq long"


def compact(spark: SparkSession, folder: str) -> None:
    """Leaves one row for each key, the latest, and one file for each run.

    What holds is added once more before the files that were there go, so a reader finds it at any time, and after a
    lost driver nothing is missing: the same row twice is one.  Nothing may be saved meanwhile.
    """
    at = spark.read.schema(_SAVED).parquet(folder)
    before = at.inputFiles()
    if not before:
        return
    fits = at.where(F.octet_length("payload") <= MOST_BYTES)
    held = fits.groupBy("run_id", "step").agg(F.max(F.struct("seq", "payload")).alias("_x")).select("run_id", "step", "_x.payload", "_x.seq")
    held.repartition("run_id").write.partitionBy("run_id").mode("append").parquet(folder)
    _remove(spark, before)


def forget(spark: SparkSession, folder: str, run_ids: list[str]) -> int:
    """Removes all saved steps of some runs, and gives how many keys these had."""
    at = spark.read.schema(_SAVED).parquet(folder).where(F.col("run_id").isin(run_ids))
    gone = at.select("run_id", "step").distinct().count()
    _remove(spark, [r["file_path"] for r in at.select("_metadata.file_path").distinct().collect()])
    return gone


def load(spark: SparkSession, folder: str, run_id: str, step: str, schema: StructType) -> DataFrame:
    """The saved step as one row of ``schema``; no row if there is none or it does not parse: the step runs again."""
    at = spark.read.schema(_SAVED).parquet(folder)
    kept = latest(at.where((F.col("run_id") == run_id) & (F.col("step") == step)))
    strict = StructType(list(schema.fields)).add("_bad", StringType())
    got = kept.select(F.from_json("payload", strict, {"columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    whole = F.lit(True)
    for f in schema.fields:
        whole = whole & (F.lit(f.nullable) | F.col(f"`{f.name}`").isNotNull())
    return got.where(F.col("_bad").isNull() & whole).drop("_bad")


def resume(findings: DataFrame, saved: DataFrame, run_id: str) -> DataFrame:
    """Adds ``cached`` to findings (ord, step, finding_id): whether the run's saved step is of that very finding."""
    done = latest(saved.where(F.col("run_id") == run_id)).select("step", F.get_json_object("payload", "$.finding_id").alias("_id"))
    return findings.join(done, "step", "left").withColumn("cached", F.coalesce(F.col("_id") == F.col("finding_id"), F.lit(False))).drop("_id")
