"""Attaches rows to the one row they mean: definitions of called names, results, headings, strategies, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.rounds import written


def _folders(path: str) -> Column:
    """(depth, prefix) for each leading part of a path's folder; depth 0 is the empty one."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("prefix")))


def folder_of(path: str) -> Column:
    """What stands before a path's last part, its slash included; empty without one."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def nearest_definitions(calls: DataFrame, definitions: DataFrame, most: int, key: list[str]) -> DataFrame:
    """(*key, folder, file, place): of the ``definitions`` (*key, file) those nearest to the ``folder`` of calls (*key, folder).

    Files that share the longest leading folders come first, ties by path, at most ``most``.  A definition is only met
    through folders it shares, and each folder offers its ``most`` first paths, which always hold the answer; so a name
    defined everywhere costs no more than ``most`` rows a folder.
    """
    # files of one folder are equally near, so that its first ones stand for it; prefixes are worked out once a folder
    few = lambda rows, part: rows.withColumn("n", F.dense_rank().over(Window.partitionBy(*key, part).orderBy("file"))).where(F.col("n") <= most).drop("n")
    placed = written(few(definitions.select(*key, "file", folder_of("file").alias("folder")), "folder").distinct())
    above = lambda rows: rows.join(rows.select("folder").distinct().select("folder", F.explode(_folders("folder")).alias("at")).select("folder", "at.*"), "folder")
    offered = few(above(placed).select(*key, "prefix", "file"), "prefix").distinct()
    asked = above(written(calls.select(*key, "folder").distinct()))
    met = asked.join(offered, [*key, "prefix"]).groupBy(*key, "folder", "file").agg(F.max("depth").alias("depth"))
    best = Window.partitionBy(*key, "folder").orderBy(F.desc("depth"), "file")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("depth")


def resolve_calls(calls: DataFrame, definitions: DataFrame, most: int = 3, key: list[str] | None = None) -> DataFrame:
    """(*key, caller_file, file, place): where a called name is defined, at most ``most`` files each; ``key`` is the name alone.

    The caller's own file wins alone; otherwise the files nearest to the caller's folder, as :func:`nearest_definitions`
    gives them: callers of one folder have the same.  Null names or files take no part.
    """
    key = key or ["name"]
    calls = calls.select(*key, "caller_file").dropna().distinct()
    defs = definitions.select(*key, "file").dropna().join(calls.select(*key).distinct(), key, "left_semi").distinct()
    own = calls.join(defs.withColumnRenamed("file", "caller_file"), [*key, "caller_file"], "left_semi")
    others = calls.join(own, [*key, "caller_file"], "left_anti").withColumn("folder", folder_of("caller_file"))
    near = others.join(nearest_definitions(others, defs, most, key), [*key, "folder"]).select(*key, "caller_file", "file", "place")
    return own.select(*key, "caller_file", F.col("caller_file").alias("file"), F.lit(1).alias("place")).unionByName(near)


def match_results(reports: DataFrame, results: DataFrame, scope: str, unique: bool = False) -> DataFrame:
    """Adds ``result``, the ``ord`` of the result that a report (file, line_start, title) is about, and ``how``.

    The first result at exactly its place, else the first whose text begins with its title (with ``unique``: only if
    no other does).  Both sides meet within one ``scope``.  Blank files and titles and null lines match nothing.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    at = results.groupBy(scope, "file", F.col("line").alias("line_start")).agg(F.min("ord").alias("by_place")).where(~blank(F.col("file")))
    left = reports.join(at, [scope, "file", "line_start"], "left")
    titles = left.where(F.col("by_place").isNull() & ~blank(F.col("title"))).select(scope, F.trim("title").alias("_title")).distinct()
    # a text is only met by titles that are its beginning: it offers one of each length that a title of its scope has
    sizes = titles.groupBy(scope).agg(F.collect_set(F.length("_title")).alias("_sizes"))
    begun = results.select(scope, "ord", "text").join(sizes, scope).select(scope, "ord", "text", F.explode(F.filter("_sizes", lambda n: n <= F.length("text"))).alias("_size"))
    begun = begun.select(scope, "ord", F.left("text", F.col("_size")).alias("_title"))
    hits = titles.join(begun, [scope, "_title"]).groupBy(scope, "_title").agg(F.min("ord").alias("by_title"), F.count("*").alias("_n"))
    if unique:
        hits = hits.where("_n = 1")
    out = left.withColumn("_title", F.trim("title")).join(hits.drop("_n"), [scope, "_title"], "left")
    how = F.when(F.col("by_place").isNotNull(), "place").when(F.col("by_title").isNotNull(), "title")
    return out.withColumn("result", F.coalesce("by_place", "by_title")).withColumn("how", how).drop("_title", "by_place", "by_title")


#: Characters by which texts that may contain each other meet.
_GRAM = 8
#: A stretch that no more long texts have leads to them at once, and pairs of ends are listed up to so many.
_FEW, _ENDS = 64, 100


def _grams(text: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def _held(asked: DataFrame, long: DataFrame, scope: str) -> DataFrame:
    """(scope, long, gram): stretches of long texts that have the length and the first and last character of one asked for."""
    ends = lambda g: F.concat(F.left(g, F.lit(1)), F.right(g, F.lit(1)))
    sizes = asked.groupBy(scope, F.length("_gram").alias("_n")).agg(F.collect_set(ends(F.col("_gram"))).alias("_ends"))
    # long texts are many even where their files are small: they are not broadcast
    met = long.join(sizes.hint("shuffle_hash"), scope).where(F.length("long") >= F.col("_n"))
    # where there are many ends, a look at each would cost more than it saves
    near = F.filter(_grams(F.col("long"), F.col("_n")), lambda g: (F.size("_ends") > _ENDS) | F.array_contains("_ends", ends(g)))
    return met.select(scope, "long", F.explode(near).alias("_gram"))


def containing(short: DataFrame, long: DataFrame, scope: str) -> DataFrame:
    """(scope, short, long): texts of ``long`` (scope, long) that contain one of ``short`` (scope, short), both distinct.

    Texts meet by the last stretch of the short one, up to eight characters; where many long ones of the scope have it, by
    the stretch that the fewest have.  They are compared then.  Empty and null texts take no part.
    """
    short = short.where("short != ''").withColumn("_n", F.least(F.length("short"), F.lit(_GRAM)))
    asked = short.select(scope, "short", F.right("short", F.col("_n")).alias("_gram"))
    same = Window.partitionBy(scope, "_gram")
    held = _held(asked, long, scope).withColumns({"_often": F.count("*").over(same), "_one": F.min("long").over(same)})
    met = written(asked.hint("merge").join(held.where((F.col("_often") <= _FEW) | (F.col("long") == F.col("_one"))).drop("_one"), [scope, "_gram"]))
    few = met.where((F.col("_often") <= _FEW) & F.contains("long", F.col("short"))).select(scope, "short", "long")
    many = met.where(F.col("_often") > _FEW).select(scope, "short")
    if many.isEmpty():
        return few
    # a stretch that no long text has rules its text out; the rarest one of the others leads to the candidates
    asked = many.select(scope, "short", F.explode(_grams(F.col("short"), F.least(F.length("short"), F.lit(_GRAM)))).alias("_gram"))
    held = _held(asked, long, scope)
    often = held.groupBy(scope, "_gram").agg(F.count("*").alias("_often"))
    best = asked.join(often, [scope, "_gram"], "left").groupBy(scope, "short").agg(F.min_by("_gram", F.struct("_often", "_gram")).alias("_gram"), F.count_if(F.col("_often").isNull()).alias("_lost")).where("_lost = 0")
    rare = best.join(held, [scope, "_gram"]).where(F.contains("long", F.col("short"))).select(scope, "short", "long")
    return few.unionByName(rare)


def match_titles(headings: DataFrame, reports: DataFrame, scope: str) -> DataFrame:
    """Adds ``report``, the ``id`` of the one report in ``scope`` whose title is the heading's.

    Titles are trimmed and lower-cased.  If several are equal there is none; if none is, the only one that contains the
    heading or is contained in it.  Blank titles match nothing.
    """
    norm = lambda c: F.lower(F.trim(c))
    h = headings.withColumn("_norm", norm(F.col("title")))
    r = reports.select(scope, "id", norm(F.col("title")).alias("_title")).where("_title != ''")
    exact = written(r.groupBy(scope, "_title").agg(F.count("*").alias("_same"), F.min("id").alias("_exact")))
    met = written(h.join(exact.withColumnRenamed("_title", "_norm").hint("merge"), [scope, "_norm"], "left"))
    open_ = written(met.where("_same is null and _norm != ''").select(scope, "_norm").distinct())
    texts = exact.select(scope, "_title")
    within = containing(texts.withColumnRenamed("_title", "short"), open_.withColumnRenamed("_norm", "long"), scope).select(scope, F.col("long").alias("_norm"), F.col("short").alias("_title"))
    around = containing(open_.withColumnRenamed("_norm", "short"), texts.withColumnRenamed("_title", "long"), scope).select(scope, F.col("short").alias("_norm"), F.col("long").alias("_title"))
    near = within.unionByName(around).distinct().join(exact.hint("merge"), [scope, "_title"]).groupBy(scope, "_norm").agg(F.sum("_same").alias("_n"), F.min("_exact").alias("_near")).where("_n = 1")
    out = met.join(near.drop("_n"), [scope, "_norm"], "left")
    return out.withColumn("report", F.when(F.col("_same") == 1, F.col("_exact")).when(F.col("_same").isNull(), F.col("_near"))).drop("_norm", "_same", "_exact", "_near")


def pick_strategy(rows: DataFrame, playbook: DataFrame) -> DataFrame:
    """Adds ``strategy`` to rows (cwe, language, frameworks): the playbook's for the weakness, else null.

    ``playbook`` (cwe, language, framework, name) is a small table: language and framework may be ``default``, a null
    framework is the language's own strategy, a null language the weakness' fallback.  The block of the row's language
    holds, else the default one; in it the first of the row's frameworks, then default, then its own; then the fallback.
    """
    named = playbook.where("language is not null").groupBy("cwe", "language").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("framework", F.lit("")), "name"))).alias("block"))
    blocks = named.groupBy("cwe").agg(F.map_from_entries(F.collect_list(F.struct("language", "block"))).alias("_blocks"))
    last = playbook.where("language is null").groupBy("cwe").agg(F.min("name").alias("_fallback"))
    met = rows.join(blocks, "cwe", "left").join(last, "cwe", "left")
    block = F.coalesce(F.try_element_at("_blocks", F.col("language")), F.try_element_at("_blocks", F.lit("default")))
    met = met.withColumn("_block", block)
    chosen = F.get(F.filter(F.transform("frameworks", lambda f: F.try_element_at("_block", f)), lambda x: x.isNotNull()), F.lit(0))
    one = lambda key: F.try_element_at("_block", F.lit(key))
    return met.withColumn("strategy", F.coalesce(chosen, one("default"), one(""), "_fallback")).drop("_blocks", "_block", "_fallback")


def chain_steps(chains: DataFrame, places: DataFrame, most: int = 20) -> DataFrame:
    """(chain, steps, dropped, more): steps as places of findings; chains with fewer than two known steps go.

    ``chains`` (chain, steps: array of long, null where a step is no integer), ``places`` (ord, place).  ``dropped``
    names the first ``most`` unknown integers, ``more`` counts the others.
    """
    step = chains.select("chain", F.posexplode("steps").alias("pos", "ord")).where("ord is not null").join(places, "ord", "left")
    listed = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", value)))), lambda x: x[value])
    got = step.groupBy("chain").agg(listed(F.col("place").isNotNull(), "place").alias("steps"), listed(F.col("place").isNull(), "ord").alias("_out")).where(F.size("steps") >= 2)
    return got.select("chain", "steps", F.slice("_out", 1, most).alias("dropped"), F.greatest(F.size("_out") - most, F.lit(0)).alias("more"))


def apply_pairs(rows: DataFrame, pairs: DataFrame, scope: str) -> DataFrame:
    """Fills ``canonical`` and ``why`` of rows (scope, ord, canonical, why) from proposed pairs.

    ``pairs`` (scope, ord, dup, canonical, why) count the rows of a scope without a canonical from 0; the first pair of
    a row that points to an earlier one holds.  Places outside the scope are left out.
    """
    free = rows.where("canonical is null").select(scope, F.col("ord").alias("_ord"), (F.row_number().over(Window.partitionBy(scope).orderBy("ord")) - 1).alias("_place"))
    met = pairs.select(scope, F.col("ord").alias("_n"), "dup", F.col("canonical").alias("_to"), F.col("why").alias("_why"))
    met = met.join(free.withColumnRenamed("_place", "dup"), [scope, "dup"]).join(free.select(scope, F.col("_ord").alias("_new"), F.col("_place").alias("_to")), [scope, "_to"]).where("_new < _ord")
    best = met.groupBy(scope, F.col("_ord").alias("ord")).agg(F.min_by(F.struct("_new", "_why"), "_n").alias("_b"))
    out = rows.join(best, [scope, "ord"], "left")
    return out.select(scope, "ord", F.coalesce("canonical", "_b._new").alias("canonical"), F.when(F.col("canonical").isNull(), F.col("_b._why")).otherwise(F.col("why")).alias("why"))
