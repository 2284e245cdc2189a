"""Groups of like files: representatives, files that fit a budget, unique folder names, cohesive groups, edge lists."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators import graph

# Folder words of environments, the one nearest to production first.
STAGES = [["/prod"], ["/cert", "/stag", "/stg"], ["/perf", "/qa"]]


def stage(path):
    low = F.lower(path)
    hit = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.coalesce(*[F.when(hit(w), F.lit(i)) for i, w in enumerate(STAGES)], F.lit(len(STAGES)))


def reduce_shapes(files: DataFrame, least: int, per_top: bool = True) -> DataFrame:
    """Adds ``role`` to files (shape, path, size, tokens): small, representative, promoted or dropped, and ``token``.

    Shapes with fewer than ``least`` files stay whole.  Of the others the first file (nearest to production, then
    largest, then by path) of each top folder, or of the shape, represents.  Going through the rest in that order, a
    file is promoted if it has a token that no representative and no earlier promoted file has; ``token`` is the least
    of these.  A file that is not promoted adds none, so a token promotes exactly the first file that holds it: one
    grouped minimum, and no walk through a shape in one task.  A null token array is unreadable: kept, as promoted
    without a token.  Paths are unique within a shape.
    """
    order = ["_stage", F.desc("size"), "path"]
    shape = Window.partitionBy("shape")
    top = F.substring_index("path", "/", 1) if per_top else F.lit("*")
    numbered = files.withColumn("_stage", stage(F.col("path"))).withColumn("_n", F.count("*").over(shape)).withColumn("_top", top)
    numbered = numbered.withColumn("_rep", F.row_number().over(Window.partitionBy("shape", "_top").orderBy(*order)) == 1)
    key = F.struct((~F.col("_rep")).alias("rest"), F.col("_stage"), (-F.col("size")).alias("big"), F.col("path"))
    numbered = numbered.withColumn("_key", key)
    held = numbered.where(F.col("_n") >= least).select("shape", "_key", F.explode("tokens").alias("token"))
    first = held.groupBy("shape", "token").agg(F.min("_key").alias("_first")).where("not _first.rest is null and _first.rest")
    news = first.groupBy("shape", F.col("_first.path").alias("path")).agg(F.min("token").alias("token"))
    met = numbered.join(news, ["shape", "path"], "left")
    role = F.when(F.col("_n") < least, "small").when(F.col("_rep"), "representative").when(F.col("token").isNotNull() | F.col("tokens").isNull(), "promoted").otherwise("dropped")
    return met.withColumn("role", role).drop("_stage", "_n", "_top", "_rep", "_key")


def take_within(rows: DataFrame, scope: str, budget: int, share: int) -> DataFrame:
    """Adds ``taken``: characters of each text (length ``size``, in order of ``ord``) that a scope's budget has left.

    No text gives more than ``share``.  What is taken up to a row is the least of the budget and the sum of capped
    sizes, so one running sum tells it.  A null size is 0.
    """
    capped = F.least(F.coalesce("size", F.lit(0)), F.lit(share)).cast("long")
    upto = F.sum(capped).over(Window.partitionBy(scope).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    room = F.lit(budget).cast("long")
    return rows.withColumn("taken", F.least(upto, room) - F.least(upto - capped, room))


def folder_names(repos: DataFrame) -> DataFrame:
    """Adds ``slug`` to (app, ord, name): the name's last part, with a hash of the name where an earlier one took it.

    A trailing ``.git`` goes; an empty part is ``repo``.  A name that repeats is hashed on, once for each repeat.  Only
    where a last part is itself another's hashed one is an app's list gone through in order, in one task.
    """
    tail = F.regexp_replace(F.substring_index(F.regexp_replace("name", "/+$", ""), "/", -1), r"(?i)\.git$", "")
    base = repos.withColumn("_base", F.when(tail == "", "repo").otherwise(tail))
    first = Window.partitionBy("app", "_base").orderBy("ord")
    base = base.withColumn("_first", F.row_number().over(first) == 1)
    again = F.count_if(~F.col("_first")).over(Window.partitionBy("app", "_base", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("_again", again.cast("int"))
    hashed = lambda salt: F.concat("_base", F.lit("-"), F.substring(F.sha1(salt), 1, 8))
    more = F.aggregate(F.sequence(F.lit(1), F.col("_again")), F.lit(""), lambda acc, _: hashed(F.concat(acc, "name")))
    named = base.withColumn("slug", F.when(F.col("_first"), F.col("_base")).otherwise(more)).drop("_first", "_again")
    # without two of the same, no name has met another's hash, and going in order gives the same
    named = named.withColumn("_n", F.count("*").over(Window.partitionBy("app", "slug"))).withColumn("_n", F.max("_n").over(Window.partitionBy("app")))
    done = named.where("_n = 1").drop("_base", "_n")
    in_order = named.where("_n > 1").drop("_n").groupBy("app").applyInPandas(_in_order, named.drop("_n").schema).drop("_base")
    return done.unionByName(in_order)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ord", kind="stable")
    used: set[str] = set()
    for i, (base, name) in enumerate(zip(rows["_base"], rows["name"], strict=True)):
        slug, salt = base, name
        while slug in used:
            slug = f"{base}-{hashlib.sha1(salt.encode()).hexdigest()[:8]}"
            salt = slug + name
        used.add(slug)
        rows.iloc[i, rows.columns.get_loc("slug")] = slug
    return rows


def cohesive(files: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, group, how): each file in one group: its first module's, else its call component's, else its folder's.

    ``modules`` (module, ord, path), ``edges`` (caller, callee) between paths; a component joins files without a module
    only and bears the stem of its first path; a folder group is the first two parts, ``.`` for bare names.
    """
    # paths shuffle to small files, so they would be broadcast: none of them goes through the driver
    files = files.select("path").dropna().distinct()
    placed = modules.groupBy("path").agg(F.min_by("module", "ord").alias("module")).hint("merge")
    met = files.join(placed, "path", "left")
    pending = met.where("module is null").select("path").hint("merge")
    both = edges.where("caller != callee").select("caller", "callee")
    touched = both.select(F.col("caller").alias("path")).unionByName(both.select(F.col("callee").alias("path"))).distinct().join(pending, "path", "left_semi")
    inner = both.join(pending.withColumnRenamed("path", "caller").hint("merge"), "caller", "left_semi").join(pending.withColumnRenamed("path", "callee").hint("merge"), "callee", "left_semi")
    linked = touched.join(graph.components(inner).withColumnRenamed("node", "path").hint("merge"), "path", "left").select("path", F.coalesce("component", "path").alias("component"))
    stem = F.regexp_replace(F.substring_index("component", "/", -1), r"(?<=.)\.[^.]*$", "")
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 2)).otherwise(".")
    out = met.join(linked.hint("merge"), "path", "left")
    how = F.when(F.col("module").isNotNull(), "module").when(F.col("component").isNotNull(), "calls").otherwise("folder")
    return out.select("path", F.coalesce("module", F.concat(F.lit("cg:"), stem), folder).alias("group"), how.alias("how"))


def edge_lines(calls: DataFrame, marked: DataFrame, most: int = 400) -> DataFrame:
    """(graph, place, line, hot): callers with their callees as lines, those that touch a marked function first.

    ``calls`` (graph, ord, caller, callee), ``marked`` (graph, function) of entry points and sinks by bare name, which is
    what follows the last ``::``.  Callees are named once, in order, ties by name; blank ones go.  ``most`` lines of a graph are given.
    """
    bare = lambda c: F.substring_index(c, "::", -1)
    once = calls.where("callee != ''").groupBy("graph", "caller", "callee").agg(F.min("ord").alias("ord"))
    m = marked.select("graph", F.col("function").alias("_f")).distinct()
    flagged = once.join(m.withColumn("_to", F.lit(True)), (once["graph"] == m["graph"]) & (bare(F.col("callee")) == F.col("_f")), "left").select(once["graph"], "caller", "callee", "ord", F.col("_to").isNotNull().alias("_hot"))
    lines = flagged.groupBy("graph", "caller").agg(F.min("ord").alias("ord"), F.max("_hot").alias("_hot"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "callee"))), lambda x: x["callee"]).alias("_to"))
    met = lines.join(m.withColumnRenamed("_f", "_g").withColumnRenamed("graph", "_graph"), (F.col("graph") == F.col("_graph")) & (bare(F.col("caller")) == F.col("_g")), "left")
    met = met.withColumn("hot", F.col("_hot") | F.col("_g").isNotNull())
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("hot"), "ord", "caller"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("graph", "place", F.concat(F.lit("  - "), "caller", F.lit(" -> "), F.array_join("_to", ", ")).alias("line"), "hot")
