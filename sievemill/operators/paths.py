"""First paths from entries to sinks through a call graph, and the chunks of files that they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import names
from sievemill.operators import coverage
from sievemill.operators.rounds import done_with, written


def _ways(step: DataFrame, goal: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(scope, node, left): fewest calls from a node to any goal, for nodes with at most ``most``; and the tables that hold it."""
    rounds = [written(goal.select("scope", "node", F.lit(0).alias("left")))]
    for n in range(1, most + 1):
        seen = reduce(DataFrame.unionByName, rounds)
        ahead = step.join(rounds[-1].select("scope", F.col("node").alias("to")).hint("merge"), ["scope", "to"]).select("scope", F.col("from").alias("node")).distinct()
        rounds.append(written(ahead.join(seen.hint("merge"), ["scope", "node"], "left_anti").select("scope", "node", F.lit(n).alias("left"))))
        if rounds[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds), rounds


def first_paths(edges: DataFrame, starts: DataFrame, sinks: DataFrame, most: int = 8) -> DataFrame:
    """(scope, start, sink, place, path): each sink within ``most`` calls of a start, by its first path.

    ``edges`` (scope, caller, callee), ``starts`` (scope, start), ``sinks`` (scope, node).  The search is breadth
    first and goes through callees in the order of their names; a node is met once for each start, from the first node
    of the level before that calls it.  ``place`` counts a start's sinks in the order they are met.  A start is no
    sink of its own.  Null names take no part.

    A node is met only where a sink is within the calls that are left, which a search back from the sinks tells first.
    That takes no path away and keeps the order: such a node's callers on earlier levels are such nodes, too.  Each
    carries its path of at most ``most`` + 1 names.  A level of one start is ordered in one task, so at most a scope's
    functions.
    """
    step = written(edges.select("scope", F.col("caller").alias("from"), F.col("callee").alias("to")).dropna().distinct())
    ways, rounds = _ways(step, sinks.select("scope", "node").dropna().distinct(), most)
    # executors join these, however small their files are: as they grow, none of them goes through the driver
    ahead = written(step.join(ways.withColumnRenamed("node", "to").hint("merge"), ["scope", "to"]).where(F.col("left") < most))
    begun = starts.select("scope", "start").dropna().distinct().join(ways.withColumnRenamed("node", "start").hint("merge"), ["scope", "start"])
    level = written(begun.select("scope", "start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0).alias("hops"), F.lit(1).alias("rank"), "left"))
    done_with(step, *rounds)
    levels = [level]
    key = ["scope", "start", "node"]
    for n in range(1, most + 1):
        near = F.col("left") <= most - n
        calls = level.select("scope", "start", F.col("node").alias("from"), "rank", "path").join(ahead.where(near).hint("merge"), ["scope", "from"])
        calls = calls.select("scope", "start", F.col("to").alias("node"), F.struct("rank", "path").alias("by"), "left", F.lit(False).alias("old"))
        known = reduce(DataFrame.unionByName, levels).where(near).select(*key, F.lit(None).cast(calls.schema["by"].dataType).alias("by"), "left", F.lit(True).alias("old"))
        # all rows of a start meet once, for what was met before, for the first caller and for the order
        met = calls.unionByName(known).repartition("scope", "start").groupBy(*key).agg(F.min("by").alias("by"), F.min("left").alias("left"), F.max("old").alias("old")).where("not old")
        order = Window.partitionBy("scope", "start").orderBy("by.rank", "node")
        level = written(met.select(*key, F.concat("by.path", F.array("node")).alias("path"), F.lit(n).alias("hops"), F.row_number().over(order).alias("rank"), "left"))
        if level.isEmpty():
            done_with(level)
            break
        levels.append(level)
    done_with(ahead)
    hits = reduce(DataFrame.unionByName, levels).where("hops > 0 and left = 0")
    order = Window.partitionBy("scope", "start").orderBy("hops", "rank")
    out = written(hits.select("scope", "start", F.col("node").alias("sink"), F.row_number().over(order).alias("place"), "path"))
    done_with(*levels)
    return out


def path_chunks(edges: DataFrame, entries: DataFrame, sinks: DataFrame, files: DataFrame, most_hops: int = 8, most: int = 40) -> DataFrame:
    """One chunk for each first path from an entry to a sink, at most ``most`` a scope, those of open entries first.

    ``entries`` (scope, ord, file, function, kind, open), ``sinks`` (scope, ord, file, function, line), ``files``
    (scope, path, loc), ``edges`` (scope, caller, callee) between ``file::function``.  Entries and sinks stand for the
    graph's nodes as :func:`coverage.match_nodes` tells; an entry's nodes are taken by name.  Entries go open ones
    first, then by kind, then as given.  An entry that reaches no sink is paired with each sink of its own file.

    A chunk holds the files of its path, then the entry's, then those of the sinks, each once, and only known ones; a
    path without any makes none.  Paths of the same function, sink and set of files make one, the first.

    Result: scope, rank, id, entry (its ord), file, function, sink, path (names), files, sinks (at most three, as
    ``file:line``), size, hypothesis.
    """
    entries, sinks = entries.where("file is not null and function is not null"), sinks.where("file is not null")
    nodes = edges.select("scope", F.col("caller").alias("node")).unionByName(edges.select("scope", F.col("callee").alias("node"))).dropna().distinct()
    # scopes keep apart in the match by a prefix of the name, which no name holds
    apart = lambda name: F.concat("scope", F.lit("\t"), name)
    of = lambda places: places.select("scope", "file", "function").dropna().distinct().select("file", apart(F.col("function")).alias("name"))
    marked = nodes.select(F.concat(names.qualified_file(F.col("node")), F.lit("::"), apart(names.qualified_name(F.col("node")))).alias("node"))
    both = coverage.match_nodes(of(entries.select("scope", "file", "function").unionByName(sinks.select("scope", "file", "function"))), marked)
    label = names.qualified_name(F.col("node"))
    plain = lambda c: F.substring_index(c, "\t", -1)
    both = written(both.select("file", plain(F.col("name")).alias("function"), F.substring_index("name", "\t", 1).alias("_s"), F.concat(names.qualified_file(F.col("node")), F.lit("::"), plain(label)).alias("node")))
    scoped = lambda rows: rows.withColumn("_s", F.col("scope").cast("string")).join(both, ["_s", "file", "function"]).drop("_s")

    begun = scoped(entries)
    ends = written(scoped(sinks))
    paths = first_paths(edges, begun.select("scope", F.col("node").alias("start")), ends.select("scope", "node"), most_hops)
    found = begun.join(paths.withColumnRenamed("start", "node"), ["scope", "node"])
    found = found.select("scope", F.col("ord").alias("entry"), "file", "function", "kind", "open", "sink", "path", F.struct(F.col("node").alias("a"), F.col("place").cast("long").alias("b")).alias("at"))
    none = entries.join(found.select("scope", F.col("entry").alias("ord")).distinct(), ["scope", "ord"], "left_anti")
    near = none.join(sinks.select("scope", "file", F.col("ord").alias("_n"), names.qualify(F.col("file"), F.coalesce("function", F.lit("None"))).alias("sink")), ["scope", "file"])
    near = near.select("scope", F.col("ord").alias("entry"), "file", "function", "kind", "open", "sink", F.array(names.qualify(F.col("file"), F.col("function")), F.col("sink")).alias("path"), F.struct(F.lit("").alias("a"), F.col("_n").cast("long").alias("b")).alias("at"))
    found = found.unionByName(near)

    here = ends.groupBy("scope", F.col("node").alias("sink")).agg(F.array_sort(F.collect_list(F.struct("ord", "file", "line"))).alias("here"))
    met = found.join(here, ["scope", "sink"], "left")
    held = F.when(F.size("here") > 0, F.col("here.file")).otherwise(F.array(names.qualified_file(F.col("sink"))))
    hops = F.filter(F.transform("path", names.qualified_file), lambda f: f != "")
    met = met.withColumn("asked", F.array_distinct(F.concat(hops, F.array("file"), held))).withColumn("_key", F.struct(~F.coalesce("open", F.lit(False)), F.col("kind"), F.col("entry"), F.col("at")))
    key = ["scope", "entry", "sink", "at"]
    known = met.select(*key, F.posexplode("asked").alias("n", "path")).join(files.select("scope", "path", "loc"), ["scope", "path"])
    known = known.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("files"), F.sum("loc").alias("loc"))
    met = met.join(known, key)
    first = Window.partitionBy("scope", "function", "sink", "_set").orderBy("_key")
    met = met.withColumn("_set", F.array_sort("files")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy("_key"))).where(F.col("rank") <= most)
    refs = F.transform(F.slice(F.coalesce("here", F.array().cast("array<struct<ord:bigint,file:string,line:bigint>>")), 1, 3), lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string")))
    refs = F.when(F.size(refs) > 0, F.array_join(refs, ", ")).otherwise(names.qualified_file(F.col("sink")))
    steps = F.transform("path", names.qualified_name)
    said = F.concat(
        F.lit("Taint path: "), F.when(F.col("open"), "UNAUTH ").otherwise(""), "kind", F.lit(" input at "), "function", F.lit("() ["), "file", F.lit("] flows via "), F.array_join(steps, " -> "),
        F.lit(" to sink "), names.qualified_name(F.col("sink")), F.lit("() ["), refs, F.lit("]. Verify every hop for sanitization/validation; if none, this is exploitable."),
    )
    return met.select("scope", "rank", F.format_string("taint-%02d", "rank").alias("id"), "entry", "file", "function", "sink", steps.alias("path"), "files", refs.alias("sinks"), names.size_class(F.col("loc")).alias("size"), said.alias("hypothesis"))
