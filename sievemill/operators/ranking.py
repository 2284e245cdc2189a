"""Orders of ranked findings, and duplicates attached to what they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators import graph

# Severities from the gravest on.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(severity) == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def priority_rank(priority: Column) -> Column:
    """The digit of P0 to P9; 9 for anything else."""
    return F.coalesce(F.when(F.upper(F.trim(priority)).rlike(r"^P\d$"), F.substring(F.trim(priority), 2, 1).cast("int")), F.lit(9))


def by_severity(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by severity, priority and ``ord``, with their ``place`` from 1: a top-k, then numbered."""
    order = [severity_rank(F.col("severity")), priority_rank(F.col("priority")), F.col("ord")]
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def attach(findings: DataFrame, links: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(ord, dup, file, line_start, line_end): the further places of each canonical finding.

    ``links`` (dup, canonical) may chain; a place counts once, from its first duplicate, and not if it overlaps the
    canonical's own lines in the same file.  ``earlier`` (ord, place, file, line_start, line_end) has the places that
    findings had before: those of a duplicate go to its root, after its own place, without a look at overlaps, and those
    that the root had come first.  Findings without a link keep theirs as they are; ``dup`` is where a place came from.
    """
    root = graph.roots(links.select(F.col("dup").alias("node"), "canonical")).where("node != root")
    own = findings.select(F.col("ord").alias("root"), F.col("file").alias("own_file"), F.col("line_start").alias("own_start"), F.col("line_end").alias("own_end"))
    met = root.join(findings, F.col("node") == F.col("ord")).drop("ord").join(own, "root")
    same = (F.col("file") == F.col("own_file")) & (F.col("line_start") <= F.col("own_end")) & (F.col("own_start") <= F.col("line_end"))
    spot = ["file", "line_start", "line_end"]
    key = lambda group, place: F.struct(F.lit(group).alias("group"), F.col("dup"), F.lit(place).cast("long").alias("place") if isinstance(place, int) else F.col(place).cast("long").alias("place"))
    found = met.where(~same).select(F.col("root").alias("ord"), F.col("node").alias("dup"), *spot).withColumn("key", key(1, -1))
    if earlier is not None:
        had = earlier.join(root.select(F.col("node").alias("ord"), "root"), "ord", "left")
        moved = had.where("root is not null").select(F.col("root").alias("ord"), F.col("ord").alias("dup"), *spot, "place").withColumn("key", key(1, "place")).drop("place")
        ends = root.select(F.col("root").alias("ord")).distinct()
        kept = had.where("root is null").join(ends, "ord", "left_semi").select("ord", F.col("ord").alias("dup"), *spot, "place").withColumn("key", key(0, "place")).drop("place")
        alone = had.where("root is null").join(ends, "ord", "left_anti").select("ord", F.col("ord").alias("dup"), *spot)
        found = found.unionByName(moved).unionByName(kept)
    once = found.groupBy("ord", *spot).agg(F.min("key").alias("key")).select("ord", "key.dup", *spot)
    return once if earlier is None else once.unionByName(alone)


# What a severity counts where there is no score.
BAND_SCORES = {"CRITICAL": 9.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.0}


def top_scored(rows: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` rows (ord, score, severity) with the highest scores, ties by ``ord``, with their ``place`` from 1.

    A null score counts as its severity's, white space and case aside; unknown ones as 0.  Without a positive ``most`` all
    rows stay as given, and ``place`` follows ``ord``.
    """
    if most is None or most <= 0:
        return rows.withColumn("place", F.row_number().over(Window.orderBy("ord")))
    band = F.upper(F.trim("severity"))
    score = F.coalesce(F.col("score").cast("double"), *[F.when(band == k, F.lit(v)) for k, v in BAND_SCORES.items()], F.lit(0.0))
    best = rows.withColumn("_score", score).orderBy(F.desc("_score"), "ord").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_score"), "ord"))).drop("_score")
