"""Findings judged as they arrive, and reconciled once all are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators import rounds


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one stream, where all executors and later runs find it; it is removed when the driver ends."""
    return rounds.new_folder(spark, "stream")


def judge_arriving(arriving: DataFrame, folder: str) -> DataFrame:
    """Writes all rows of a stream that are there now, each judged once and exactly once, and reads them back."""
    query = arriving.writeStream.format("parquet").option("path", f"{folder}/judged").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return arriving.sparkSession.read.schema(arriving.schema).parquet(f"{folder}/judged")


def reconcile(judged: DataFrame, keys: list[str], best: str, order: str) -> DataFrame:
    """Adds ``retained``: true for the best row of each key (ties: first); the others were judged speculatively."""
    pick = judged.groupBy(*keys).agg(F.max_by(order, F.struct(best, -F.col(order))).alias("_kept")).select(F.col("_kept"))
    return judged.join(pick, judged[order] == F.col("_kept"), "left").withColumn("retained", F.col("_kept").isNotNull()).drop("_kept")
