"""Rollups, positional percentiles and weighted gate scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weight of each gate, multiplier of each status, thresholds.
WEIGHTS = {"root_cause": 0.43, "instance_coverage": 0.2467, "no_new_vulnerabilities": 0.1867, "security_best_practices": 0.1366}
MULTIPLIERS = {"pass": 1.0, "partial": 0.5, "fail": 0.0, "invalid": 0.0}
FIXED, PARTIAL, COVERAGE = 0.8, 0.5, 0.5
CRITICAL = ["no_new_vulnerabilities"]


def directory_rollup(files: DataFrame, depth: int = 3) -> DataFrame:
    """How many files each directory holds, at any depth below it; directories down to ``depth``."""
    parts = F.split("path", "/")
    above = F.least(F.size(parts) - 1, F.lit(depth))
    ancestors = F.when(above > 0, F.transform(F.sequence(F.lit(1), above), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return files.select(F.explode(ancestors).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def positional_percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, least, p50 (place n div 2), p90 (place min(n - 1, 0.9 n)) and most of each group, without interpolation.

    Values are first counted, so a group brings its distinct values together, not its rows.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    upto = counted.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    p90 = F.least(F.col("n") - 1, F.floor(F.lit(0.9) * F.col("n")))
    return upto.groupBy(group).agg(F.first("n").alias("n"), F.min(value).alias("least"), at(F.floor(F.col("n") / 2)).alias("p50"), at(p90).alias("p90"), F.max(value).alias("most"))


def gate_score(gates: DataFrame, key: str = "finding_id") -> DataFrame:
    """score (4 places) and label of each finding from rows (key, gate, status); fails closed.

    A set of gates that is not exactly the expected one, a critical gate that is skipped or invalid, or too
    little weight evaluated make it UNVERIFIABLE; a critical gate that is not clean caps the best label.
    """
    credit = F.coalesce(*[F.when(F.col("status") == s, F.lit(m)) for s, m in MULTIPLIERS.items()], F.lit(0.0))
    active = F.col("status") != "skip"
    critical = F.col("gate").isin(CRITICAL)
    # each gate comes once or the set is bad; adding them in one order makes ties in rounding the same in every run
    total = lambda share: reduce(add, [F.max(F.when(active & (F.col("gate") == g), share * w).otherwise(0.0)) for g, w in WEIGHTS.items()])
    sums = gates.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_distinct("gate").alias("gates"),
        F.count_if(~F.col("gate").isin(list(WEIGHTS))).alias("unknown"),
        total(F.lit(1.0)).alias("weight"),
        total(credit).alias("earned"),
        F.count_if(critical & F.col("status").isin("skip", "invalid")).alias("open"),
        F.count_if(critical & F.col("status").isin("partial", "fail")).alias("unclean"),
    )
    shape = (F.col("gates") != len(WEIGHTS)) | (F.col("unknown") > 0) | (F.col("rows") != F.col("gates"))
    bad = shape | (F.col("open") > 0) | (F.round("weight", 6) < COVERAGE)
    score = F.when(bad, 0.0).otherwise(F.round(F.least(F.col("earned") / F.col("weight"), F.lit(1.0)), 4))
    label = F.when(bad, "UNVERIFIABLE").when((score >= FIXED) & (F.col("unclean") == 0), "FIXED").when(score >= PARTIAL, "PARTIAL").otherwise("NOT_FIXED")
    return sums.select(key, score.alias("score"), label.alias("label"))


def dominant(rows: DataFrame, group: str, value: str, order: str = "ord") -> DataFrame:
    """The commonest value of each group; of equally common ones the first seen."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("value"), F.max("n").alias("n"))
