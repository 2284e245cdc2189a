"""Chunks of files that are too large for one look are split into numbered parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import names
from sievemill.operators import graph, windows


def groups(files: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``group`` and ``key`` to files (scope, chunk, path): what belongs together, and where it stands in its chunk.

    ``modules`` (scope, ord, place, path) come first, in their order and with their files in theirs; a file belongs to
    the first that names it.  Then files that calls (``edges``: scope, caller, callee) connect within the chunk, without
    those of modules; a file that only calls files elsewhere stands alone.  Then the first two parts of a path, ``.``
    for a bare name.  ``key`` orders all files of a chunk.
    """
    named = modules.groupBy("scope", "path").agg(F.min(F.struct("ord", "place")).alias("m"))
    met = files.join(named, ["scope", "path"], "left")
    rest = met.where("m is null").select("scope", "chunk", "path")
    node = lambda path: F.concat_ws("\t", F.col("scope").cast("string"), F.col("chunk").cast("string"), path)
    both = edges.where("caller != callee").select("scope", "caller", "callee")
    touched = both.select("scope", F.col("caller").alias("path")).unionByName(both.select("scope", F.col("callee").alias("path"))).distinct()
    inner = both.join(rest.select("scope", "chunk", F.col("path").alias("caller")), ["scope", "caller"]).join(rest.select("scope", "chunk", F.col("path").alias("callee")), ["scope", "chunk", "callee"])
    linked = graph.components(inner.select(node(F.col("caller")).alias("caller"), node(F.col("callee")).alias("callee"))).select("node", F.substring_index("component", "\t", -1).alias("component"))
    placed = rest.join(touched, ["scope", "path"], "left_semi").withColumn("node", node(F.col("path"))).join(linked, "node", "left").select("scope", "chunk", "path", F.coalesce("component", "path").alias("component"))
    met = met.join(placed, ["scope", "chunk", "path"], "left")
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 2)).otherwise(".")
    kind = F.when(F.col("m").isNotNull(), 0).when(F.col("component").isNotNull(), 1).otherwise(2)
    label = F.when(F.col("m").isNotNull(), "").otherwise(F.coalesce("component", folder))
    group = F.struct(kind.alias("kind"), F.coalesce("m.ord", F.lit(0)).cast("long").alias("module"), label.alias("label"))
    return met.withColumn("group", group).withColumn("key", F.struct(group.alias("group"), F.coalesce("m.place", F.lit(0)).cast("long").alias("place"), F.col("path"))).drop("m", "component")


def split(files: DataFrame, modules: DataFrame, edges: DataFrame, most_loc: int = 8000, most_files: int = 25, most_chars: int | None = None) -> DataFrame:
    """(scope, chunk, part, id, files, loc, size): chunks of ``files`` (scope, chunk, ord, path, loc, chars), split where too large.

    A chunk fits with at most ``most_loc`` lines (with ``most_chars``: characters) and ``most_files`` files, and stays as it
    is.  Others are split: each of its :func:`groups` fills parts in order, and no part holds files of two groups; a
    single file beyond the bound is a part of its own.  Parts count from 1; their ids end in a to z, then in the number.
    A null size counts 0; paths are unique in a chunk.
    """
    weight = F.coalesce(F.col("loc" if most_chars is None else "chars"), F.lit(0)).cast("long")
    bound = most_loc if most_chars is None else most_chars
    sized = files.withColumn("loc", F.coalesce("loc", F.lit(0)).cast("long")).withColumn("weight", weight)
    whole = sized.groupBy("scope", "chunk").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    fits = (F.col("total") <= bound) & (F.col("n") <= most_files)
    rows = sized.join(whole, ["scope", "chunk"])
    kept = rows.where(fits).select("scope", "chunk", F.lit(None).cast("int").alias("part"), "path", "loc", F.col("ord").cast("long").alias("at"))
    large = groups(rows.where(~fits).select("scope", "chunk", "path", "loc", "weight"), modules, edges)
    large = large.withColumn("pack", F.concat_ws("\t", F.col("scope").cast("string"), F.col("chunk").cast("string"), F.col("group.kind").cast("string"), F.col("group.module").cast("string"), "group.label"))
    shards = windows.pack_in_order(large.select("pack", F.col("key").alias("ord"), F.col("weight").alias("size")), "pack", bound, most_files).withColumnRenamed("ord", "key")
    order = Window.partitionBy("scope", "chunk").orderBy("key.group", "shard")
    numbered = large.join(shards, ["pack", "key"]).withColumn("part", F.dense_rank().over(order))
    place = F.row_number().over(Window.partitionBy("scope", "chunk", "part").orderBy("key"))
    parts = numbered.select("scope", "chunk", "part", "path", "loc", place.cast("long").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"])
    out = kept.unionByName(parts).groupBy("scope", "chunk", "part").agg(listed.alias("files"), F.sum("loc").alias("loc"))
    ending = F.when(F.col("part") <= 26, F.chr(F.col("part") + 96)).otherwise(F.col("part").cast("string"))
    name = F.when(F.col("part").isNull(), F.col("chunk").cast("string")).otherwise(F.concat(F.col("chunk").cast("string"), F.lit("-"), ending))
    return out.select("scope", "chunk", "part", name.alias("id"), "files", "loc", names.size_class(F.col("loc")).alias("size"))
