"""Chunks, reports and findings by kind, rank, request and place."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import paths
from sievemill.functions.globs import first_hit
from sievemill.operators.aggregates import MULTIPLIERS, WEIGHTS

# Statuses that a validation can start from.
VALIDATABLE = ["awaiting_validation", "needs_review", "validation_failed"]


def chunk_kind(chunk: Column, specialist: Column) -> Column:
    return F.when(specialist, "specialist").when(chunk.startswith("catchall-"), "catchall").otherwise("risk")


def assign_ranks(chunks: DataFrame, shift: int, group: str = "repo") -> DataFrame:
    """rank of chunks (repo, kind, ord, risk_rank): taint chunks from 1, risk chunks behind ``shift`` places, then catch-alls,
    then specialists, these two numbered on from the highest rank before them."""
    everything = Window.partitionBy(group)
    nth = F.row_number().over(Window.partitionBy(group, "kind").orderBy("ord"))
    own = F.when(F.col("kind") == "taint", nth).when(F.col("kind") == "risk", F.col("risk_rank") + shift)
    rows = chunks.withColumn("_own", own).withColumn("_nth", nth)
    base = F.coalesce(F.max("_own").over(everything), F.lit(0))
    caught = F.count_if(F.col("kind") == "catchall").over(everything)
    rank = F.coalesce("_own", base + F.col("_nth") + F.when(F.col("kind") == "specialist", caught).otherwise(0))
    return rows.withColumn("rank", rank.cast("long")).drop("_own", "_nth")


def skip_names(rows: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Every row with the pattern that skips it, or null."""
    return rows.withColumn("skipped_by", paths.name_hit(F.col(name), patterns))


def forbidden_files(changes: DataFrame, forbid: list[str], deny: list[str]) -> DataFrame:
    """Changed files that a pattern of either list hits, and the hits; files without a name can't be hit."""
    plain = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    hit = changes.where("file != ''").withColumn("forbid_hit", first_hit(plain, forbid)).withColumn("deny_hit", first_hit(plain, deny))
    return hit.where("forbid_hit is not null or deny_hit is not null")


def top_by_score(reports: DataFrame, most: int) -> DataFrame:
    """The ``most`` validatable reports of the highest score; a score that is no number counts as 0, ties go to the first found."""
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    return reports.where(F.col("status").isin(VALIDATABLE)).withColumn("value", score).orderBy(F.desc("value"), "ord").limit(most)


def select_by_id(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """One row (place, id, problem) for each request; problem is null where the report can be validated."""
    known = reports.select(F.col("id").alias("_id"), "status")
    met = requests.join(known, F.col("id") == F.col("_id"), "left")
    unset = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("unset"))
    problem = F.when(F.col("_id").isNull(), "not found").when(~F.coalesce(F.col("status").isin(VALIDATABLE), F.lit(False)), F.concat(F.lit("status '"), unset, F.lit("'")))
    return met.select("place", "id", problem.alias("problem"))


def effective_scores(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """score, label and readiness of each requested finding; one without a score is UNVERIFIABLE."""
    met = requests.join(scores, "finding_id", "left").select("finding_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit("UNVERIFIABLE")).alias("label"))
    return met.withColumn("readiness", F.when(F.col("label") == "FIXED", "Ready").when(F.col("label") == "PARTIAL", "Ready with Conditions").otherwise("Not Ready"))


def gate_map(gates: DataFrame, order: str, key: str = "finding_id") -> DataFrame:
    """Of each finding a map from gate to (status, weight, weighted); of repeated gates the last in ``order`` counts.

    An unknown gate or status weighs nothing.
    """
    last = gates.groupBy(key, "gate").agg(F.max_by("status", order).alias("status"))
    weight = F.coalesce(*[F.when(F.col("gate") == g, F.lit(w)) for g, w in WEIGHTS.items()], F.lit(0.0))
    product = [F.when((F.col("gate") == g) & (F.col("status") == s), F.lit(round(w * m, 4))) for g, w in WEIGHTS.items() for s, m in MULTIPLIERS.items()]
    entry = F.struct("gate", F.struct("status", weight.alias("weight"), F.coalesce(*product, F.lit(0.0)).alias("weighted")))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("gates"))


def positions(rows: DataFrame, keys: list[str], ord_: str = "ord", width: int = 65_536) -> DataFrame:
    """``position`` (from 0) of each row in the order of ``keys``, then ``ord_``.

    Rows are numbered within cells of ``width`` ids, cells within their keys; only one number for each key meets in one
    task.
    """
    cell = F.floor(F.col(ord_) / width)
    celled = rows.withColumn("_cell", cell)
    counts = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    base = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.sum("_all").over(Window.orderBy(*keys)) - F.col("_all")).alias("_base"))
    within = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    before = within.join(base, same).select(*keys, "_cell", (F.col("_base") + F.col("_upto")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(ord_)) - 1
    return celled.withColumn("_nth", nth).join(before, [*keys, "_cell"]).withColumn("position", F.col("_before") + F.col("_nth")).drop("_cell", "_nth", "_before")


def remap_canonical(dropped: DataFrame, placed: DataFrame) -> DataFrame:
    """Dropped rows whose canonical row is kept point to its place; others keep what they pointed to."""
    to = placed.select(F.col("ord").alias("_ord"), "position")
    met = dropped.join(to, (F.col("canonical") == F.col("_ord")) & (F.col("reason") == "DUPLICATE"), "left")
    return met.withColumn("canonical", F.coalesce("position", "canonical")).drop("_ord", "position")


def callers_of(files: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` callers (in order) of something in each file, which a callee's file is or ends with.

    A callee's file is joined by all its endings, so that files meet by equality.
    """
    ends = edges.select("caller", F.explode(paths.suffixes(F.col("callee_file"))).alias("file")).distinct()
    met = ends.join(files.select("file").distinct(), "file")
    return met.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("caller"))).where(F.col("nth") <= most)
