"""Patches of repositories from the texts of their files before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import commands, diffs


def file_diffs(files: DataFrame, exact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scope, ord, path, diff, and what ``keep`` names): the files of ``files`` (scope, ord, path, before, after) that have changed.

    A path that leaves its repository, or names another host, takes no part; of repeated paths the first counts.  Paths
    lose ``.`` and ``..``.  Versions meet in their own row, so no text is held beyond it.
    """
    root = "/repo"
    inside = F.when(~commands.network_path(F.col("path")), commands.within(F.col("path"), root))
    rows = files.withColumn("path", F.substring(inside, len(root) + 2, 1 << 30)).where("path != ''")
    first = Window.partitionBy("scope", "path").orderBy("ord")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.where(~F.coalesce("before", F.lit("")).eqNullSafe(F.coalesce("after", F.lit("")))).select("scope", "ord", "path", diffs.diff(F.col("before"), F.col("after"), F.col("path"), exact).alias("diff"), *keep)


def patches(found: DataFrame) -> DataFrame:
    """(scope, patch): the diffs of a scope's files in order, under a line that tells that they are no version control's."""
    one = F.array_sort(F.collect_list(F.struct("ord", "path", "diff")))
    return found.groupBy("scope").agg(F.concat(F.lit(diffs.HEADER), F.array_join(F.transform(one, lambda x: x["diff"]), "")).alias("patch"))
