"""Which sinks, threats and files belong to what: graph nodes, threats of entries, files of paths, orders and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _endings(path: Column) -> Column:
    """All endings of a path that begin after a slash, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_nodes(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, name, node, how): the graph nodes ``file::name`` that a place (file, name) means.

    Those of its very file; else those whose file ends with it after a slash, or it with theirs; else ``file::name``
    itself as ``new``.  Endings are matched as keys, so no place meets nodes that it does not match.
    """
    place = places.select("file", "name").dropna().distinct()
    n = nodes.select("node", F.substring_index("node", "::", -1).alias("name"), F.regexp_replace(F.expr("substring(node, 1, length(node) - length(substring_index(node, '::', -1)))"), "::$", "").alias("of")).dropna().distinct()
    exact = place.join(n.withColumnRenamed("of", "file"), ["file", "name"]).select("file", "name", "node", F.lit("exact").alias("how"))
    rest = place.join(exact, ["file", "name"], "left_anti")
    longer = rest.join(n.select("node", "name", F.explode(_endings(F.col("of"))).alias("file")), ["file", "name"]).select("file", "name", "node")
    shorter = rest.select("file", "name", F.explode(_endings(F.col("file"))).alias("of")).join(n, ["of", "name"]).select("file", "name", "node")
    ending = longer.unionByName(shorter).distinct().withColumn("how", F.lit("ending"))
    new = rest.join(ending, ["file", "name"], "left_anti").select("file", "name", F.concat("file", F.lit("::"), "name").alias("node"), F.lit("new").alias("how"))
    return exact.unionByName(ending).unionByName(new)


def threats_of(entries: DataFrame, threats: DataFrame, scope: str) -> DataFrame:
    """Adds ``threat`` to entries (scope, function): the first one that is called like it, else the first that shares a word.

    ``threats`` (scope, ord, id, surface).  Words are runs of a-z and 0-9, case aside; blank surfaces and functions
    match nothing by word.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    named = threats.where("surface != ''")
    same = named.groupBy(scope, F.lower("surface").alias("_f")).agg(F.min_by("id", "ord").alias("_same"))
    asked = entries.select(scope, F.lower("function").alias("_f")).where("_f is not null").distinct()
    first = named.select(scope, "ord", "id", F.explode(words(F.col("surface"))).alias("_w")).groupBy(scope, "_w").agg(F.min(F.struct("ord", "id")).alias("_t"))
    near = asked.select(scope, "_f", F.explode(words(F.col("_f"))).alias("_w")).join(first, [scope, "_w"]).groupBy(scope, "_f").agg(F.min("_t").alias("_near"))
    out = entries.withColumn("_f", F.lower("function")).join(same, [scope, "_f"], "left").join(near, [scope, "_f"], "left")
    return out.withColumn("threat", F.coalesce("_same", "_near.id")).drop("_f", "_same", "_near")


def threat_coverage(chunks: DataFrame, threats: DataFrame, scope: str) -> DataFrame:
    """(scope, threats, covered, missing): threats that a chunk (scope, threat) names; unknown names cover nothing."""
    known = threats.select(scope, F.col("id").alias("threat")).distinct()
    hit = chunks.select(scope, "threat").distinct().withColumn("_hit", F.lit(1))
    met = known.join(hit, [scope, "threat"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col("threat"))))
    return met.groupBy(scope).agg(F.count("*").alias("threats"), F.count("_hit").alias("covered"), missing.alias("missing"))


def hop_files(candidates: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """(path, file, place): the first ``most`` files of each path, those sharing the longest leading parts with an anchor first.

    ``candidates`` (path, ord, file), ``anchors`` (path, file).  Without more than ``most`` files, or with 0 for it, they
    keep their order.  Files are dealt by path once and stay there; the leading parts of a path's few anchors come to
    them, and a file shares as many parts as its own leading parts are among these.
    """

    def leads(file: Column) -> Column:
        parts = F.split(file, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))

    once = candidates.select("path", "file", "ord").repartition("path").groupBy("path", "file").agg(F.min("ord").alias("ord"))
    ahead = anchors.where("file != ''").groupBy("path").agg(F.collect_set("file").alias("_anchors"))
    ahead = ahead.select("path", F.array_distinct(F.flatten(F.transform("_anchors", leads))).alias("_ahead")).hint("merge")
    shared = F.when(F.col("_ahead").isNotNull(), F.size(F.filter(leads(F.col("file")), lambda x: F.array_contains("_ahead", x))))
    met = once.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).join(ahead, "path", "left").withColumn("depth", shared)
    few = F.lit(most <= 0) | (F.col("_n") <= most)
    order = Window.partitionBy("path").orderBy(F.when(few, F.col("ord")), F.when(~few, -F.coalesce("depth", F.lit(0))), "file")
    ranked = met.withColumn("place", F.row_number().over(order))
    return ranked.where(few | (F.col("place") <= most)).select("path", "file", "place")


def entry_order(entries: DataFrame, scope: str, most: int) -> DataFrame:
    """Entries (kind, unauth, file) with ``place``, network ones first, then those open to all, by kind and file."""
    first = F.struct(F.coalesce(F.col("kind") != "network", F.lit(True)), ~F.coalesce("unauth", F.lit(False)), F.col("kind"), F.col("file"), F.col("ord"))
    w = Window.partitionBy(scope)
    out = entries.withColumn("place", F.row_number().over(w.orderBy(first))).withColumn("truncated", F.count("*").over(w) > most)
    return out.where(F.col("place") <= most)


def risk_order(chunks: DataFrame, scope: str, unknown: int = 999) -> DataFrame:
    """Chunks with ``place`` by ``risk_rank``; one that is no integer counts as ``unknown``, equal ones keep their order."""
    rank = F.coalesce(F.trim(F.col("risk_rank").cast("string")).try_cast("int"), F.lit(unknown))
    ranked = chunks.withColumn("rank", rank)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy("rank", "ord")))


def progress(ended: DataFrame, run: str, parallel: int) -> DataFrame:
    """Each ended chunk (run, ord, elapsed, total) with how far the run was: done, active, queued, percent, eta in seconds."""
    done = F.row_number().over(Window.partitionBy(run).orderBy("elapsed", "ord"))
    out = ended.withColumn("done", done).withColumn("_left", F.greatest(F.col("total") - F.col("done"), F.lit(0)))
    out = out.withColumn("active", F.least(F.lit(max(1, parallel)), F.col("_left")).cast("long"))
    share = F.rint(F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(100.0)).cast("long")
    return out.withColumns({"queued": (F.col("_left") - F.col("active")).cast("long"), "percent": share, "eta": F.col("elapsed") / F.col("done") * F.col("_left")}).drop("_left")
