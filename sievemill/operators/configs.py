"""Settings files of many environments that have one shape: which to look at, and a report of the shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import judgement, keypaths
from sievemill.operators import clusters

# Endings of settings files, files of a shape from which it is thinned out, and the largest file in kilobytes.
ENDINGS = [".yml", ".yaml", ".json", ".toml", ".ini", ".properties", ".conf", ".cfg", ".env"]
LEAST, MOST_KB = 3, 512


def roles(files: DataFrame, least: int = LEAST, per_top: bool = True, endings: list[str] = ENDINGS, most_kb: int = MOST_KB) -> DataFrame:
    """(scope, ord, path, size, shape, role, token): what becomes of each of ``files`` (scope, ord, path, size, text).

    ``other``: no settings file; ``unreadable``: too large, without a text, or without a name; both are kept.  The rest has
    the role that :func:`clusters.reduce_shapes` gives within its scope, by the shape of its names: small, representative and
    promoted files are kept, dropped ones are not.  Paths are unique in a scope.
    """
    ending = F.lower(F.regexp_extract("path", r"(?<=[^/])(\.[^./]+)$", 1))
    rows = files.withColumn("_end", ending).withColumn("_is", F.col("_end").isin(endings))
    read = F.col("_is") & (F.coalesce("size", F.lit(0)) <= most_kb * 1024)
    rows = rows.withColumn("shape", keypaths.shape(keypaths.key_paths(F.when(read, F.col("text")), F.col("_end"))))
    rest = rows.where("shape is null").select("scope", "ord", "path", "size", "shape", F.when(F.col("_is"), "unreadable").otherwise("other").alias("role"), F.lit(None).cast("string").alias("token"))
    found = rows.where("shape is not null").select("scope", "ord", "path", "size", F.col("shape").alias("_shape"), F.concat(F.col("scope").cast("string"), F.lit("\t"), "shape").alias("shape"), judgement.suspicious(F.col("text")).alias("tokens"))
    thinned = clusters.reduce_shapes(found, least, per_top).withColumn("shape", F.col("_shape"))
    return rest.unionByName(thinned.select("scope", "ord", "path", "size", "shape", "role", "token"))


def report(done: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of the result of :func:`roles`: counts for each scope, and its ``most`` largest thinned shapes.

    (scope, candidates, unreadable, shapes, representatives, promoted, dropped) and (scope, place, shape, size,
    representatives, dropped, sample): shapes go by size, then by their first file; ``sample`` is the file nearest to
    production, a shape is named by twelve digits.
    """
    is_ = lambda *r: F.count_if(F.col("role").isin(*r))
    large = F.col("role").isin("representative", "promoted", "dropped")
    total = done.groupBy("scope").agg(
        F.count_if(F.col("role") != "other").alias("candidates"), is_("unreadable").alias("unreadable"), F.count_distinct(F.when(large, F.col("shape"))).alias("shapes"), is_("representative").alias("representatives"), is_("promoted").alias("promoted"), is_("dropped").alias("dropped")
    )
    first = F.struct(clusters.stage(F.col("path")).alias("stage"), (-F.col("size")).alias("big"), F.col("path").alias("path"))
    by = done.where(large).groupBy("scope", "shape").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("role") == "representative", F.col("path")))).alias("representatives"), is_("dropped").alias("dropped"), F.min(first)["path"].alias("sample"), F.min("ord").alias("_at")
    )
    order = Window.partitionBy("scope").orderBy(F.desc("size"), "_at")
    top = by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return total, top.select("scope", "place", F.left("shape", F.lit(12)).alias("shape"), "size", "representatives", "dropped", "sample")
