"""Readers of the text formats around findings: CSV sheets, JSON lines, JSON feeds, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sheet(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """A CSV sheet with lower-case column names; of rows with the same key (trimmed, any case) the last wins.

    Comment and blank lines are skipped, a byte order mark is ignored, short rows end in nulls, rows without
    a key go.  Raises ValueError if no column is named like the key.
    """
    raw = spark.read.csv(path, header=True, comment="#", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c.lstrip("﻿").strip().lower() for c in raw.columns]
    if key not in names:
        raise ValueError(f"{path} has no column {key}")
    # ids grow with the place in the file, as parts of a file are numbered in order
    rows = raw.toDF(*names).withColumn("_place", F.monotonically_increasing_id()).withColumn("_key", F.lower(F.trim(key))).where("_key != ''")
    last = rows.groupBy("_key").agg(F.max_by(F.struct(*names), "_place").alias("row"))
    return last.select("row.*")


def error_counts(spark: SparkSession, path: str) -> DataFrame:
    """stage, n of a log of JSON lines; garbled lines are skipped."""
    rows = spark.read.schema("stage string").json(path, mode="DROPMALFORMED")
    return rows.where("stage is not null").groupBy("stage").agg(F.count("*").alias("n"))


def append_errors(errors: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    errors.write.mode("append").json(path)


def feed(spark: SparkSession, path: str, schema: str, field: str = "cves", required: str = "id") -> DataFrame:
    """Items of a JSON document that is a list or has one under ``field``; bad items and bad files are dropped."""
    text = spark.read.text(path, wholetext=True)
    item = lambda c: F.from_json(c, f"array<{schema}>")
    items = F.coalesce(item(F.when(F.ltrim("value").startswith("["), F.col("value"))), item(F.get_json_object("value", f"$.{field}")))
    return text.select(F.explode(items).alias("item")).select("item.*").where(F.col(required).isNotNull())


def changed_paths(diffs: DataFrame, key: str, text: str = "diff", part: str | None = None) -> DataFrame:
    """key, path, place: paths that a unified diff changes, each at its first place, without the null device.

    A long diff may come in parts that end with a line, in the order of ``part``: ``place`` is then (part, line in it).
    """
    lines = diffs.select(key, *([part] if part else []), F.posexplode(F.split(text, "\r?\n")).alias("place", "line"))
    if part:
        lines = lines.withColumn("place", F.struct(part, "place"))
    old = F.regexp_extract("line", r"^(?:diff --git|---) (?:a/)?(\S+)", 1)
    new = F.coalesce(F.nullif(F.regexp_extract("line", r"^diff --git \S+ (?:b/)?(\S+)", 1), F.lit("")), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1))
    found = lines.where(F.col("line").rlike(r"^(diff --git|---|\+\+\+) ")).select(key, "place", F.explode(F.array(old, new)).alias("path"))
    return found.where("path not in ('', '/dev/null')").groupBy(key, "path").agg(F.min("place").alias("place"))


def manifest_entries(lines: DataFrame, local: Column) -> DataFrame:
    """(file, lineno, app_id, name, ref, errors) for lines (file, lineno, line) of ``application,repository,path``.

    Blank lines and comments go.  ``local`` tells whether ``ref`` is a folder that exists.  ``errors`` is empty for an
    entry; a path that an earlier entry of the file has is an error, too.  No null line or path makes an entry.
    """
    raw = lines.withColumn("_t", F.trim("line")).where("_t != '' and not startswith(_t, '#')")
    part = F.transform(F.split("_t", ","), lambda x: F.trim(x))
    raw = raw.withColumn("_p", part)
    of = lambda i: F.coalesce(F.get("_p", i), F.lit(""))
    row = raw.select("file", "lineno", F.size("_p").alias("_n"), of(0).alias("app_id"), of(1).alias("name"), of(2).alias("ref"))
    at = F.concat(F.lit("line "), F.col("lineno").cast("string"), F.lit(": "))
    blank = F.array_compact(F.array(*[F.when(F.col(c) == "", F.concat(at, F.lit(f"{label} is empty"))) for c, label in (("app_id", "application_id"), ("name", "repository_name"), ("ref", "path"))]))
    remote = F.col("ref").rlike("^(https?://|git@|ssh://)") | F.col("ref").endswith(".git")
    about = lambda text: F.array(F.concat(at, F.lit("path '"), "ref", F.lit(f"' {text}")))
    wrong = F.when(F.col("_n") != 3, F.array(F.concat(at, F.lit("expected 3 comma-separated fields (application_id,repository_name,path) — got "), F.col("_n").cast("string")))).when(F.size(blank) > 0, blank)
    wrong = wrong.when(F.col("ref").startswith("-"), about("may not start with '-'")).when(~remote & ~F.coalesce(local, F.lit(False)), about("is neither a git URL nor an existing local directory"))
    row = row.withColumn("errors", wrong)
    first = F.min(F.when(F.col("errors").isNull(), F.col("lineno"))).over(Window.partitionBy("file", "ref"))
    again = F.array(F.concat(at, F.lit("duplicate path '"), "ref", F.lit("'")))
    return row.withColumn("errors", F.coalesce("errors", F.when(F.col("lineno") > first, again), F.array().cast("array<string>"))).drop("_n")
