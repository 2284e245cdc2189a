"""Lookups with inheritance, as-of and pattern joins, and matches that must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.globs import to_regex


def inherit(children: DataFrame, parents: DataFrame, key: str, parent_key: str, flags: list[str]) -> DataFrame:
    """Each blank (null) flag of a child takes its parent's value, else false; ``origin`` tells whether one did."""
    up = parents.select(F.col(key).alias("up_key"), *[F.col(f).alias(f"up_{f}") for f in flags])
    joined = children.join(up, (F.col(parent_key) == F.col("up_key")) & (F.col(parent_key) != F.col(key)), "left")
    blank = F.greatest(*[F.col(f).isNull() & F.col(f"up_{f}").isNotNull() for f in flags])
    merged = [F.coalesce(f, f"up_{f}", F.lit(False)).alias(f) for f in flags]
    return joined.select(*[c for c in children.columns if c not in flags], *merged, F.when(blank, "parent").otherwise("own").alias("origin"))


def as_of(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each call (file, line, ord) with the latest definition (file, line, name) at or before it, else ``<module>``.

    Both sides are sorted together once; no pair of a call with an earlier definition is made.
    """
    both = definitions.select("file", "line", F.lit(0).alias("is_call"), "name", F.lit(None).cast("long").alias("ord")).unionByName(calls.select("file", "line", F.lit(1).alias("is_call"), F.lit(None).cast("string").alias("name"), "ord"))
    w = Window.partitionBy("file").orderBy("line", "is_call", F.desc_nulls_last("name")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("enclosing", F.coalesce(F.last("name", True).over(w), F.lit("<module>"))).where("is_call = 1").select("ord", "file", "line", "enclosing")


def glob_join(rows: DataFrame, path: str, controls: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds ``controls``: names of those without patterns or with one that matches, in their order."""
    hit = lambda globs: F.lit(True) if not globs else F.col(path).rlike("|".join(to_regex(g) for g in globs))
    return rows.withColumn("controls", F.array_compact(F.array(*[F.when(hit(g), F.lit(n)) for n, g in controls])))


def resolve_unique(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Asked paths by exact path, else by a basename that only one file has; ``how`` is exact, basename or none."""
    exact = files.select(F.col("path").alias("hit")).distinct()
    base = lambda c: F.substring_index(c, "/", -1)
    named = files.groupBy(base(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("name", "only")
    met = asked.join(exact, F.col("path") == F.col("hit"), "left").join(named, base(F.col("path")) == F.col("name"), "left")
    how = F.when(F.col("hit").isNotNull(), "exact").when(F.col("only").isNotNull(), "basename").otherwise("none")
    return met.select("path", F.coalesce("hit", "only").alias("resolved"), how.alias("how"))


FLAGS = ["external", "pci", "pan", "pii"]


def _key(c: str) -> Column:
    """An id without the zeros before it; null and blank ones are none."""
    bare = F.regexp_replace(F.trim(c), "^0+", "")
    return F.when(F.trim(c) != "", F.when(bare == "", "0").otherwise(bare))


def lookup_apps(asked: DataFrame, applications: DataFrame, components: DataFrame) -> DataFrame:
    """Adds id, name, parent_id, the FLAGS and ``source`` to asked ids (app): what is known of each application.

    ``applications`` and ``components`` (ord, id, name, parent_id, FLAGS): a null flag is blank; of ids that only differ by
    leading zeros the last counts.  An application goes before a component.  With a blank flag it takes its parent's (or
    the component's parent's), if that is another known application; a component always does.  ``source`` tells which.
    Flags that stay blank are false; an unknown id has nulls.
    """
    fields = ["id", "name", "parent_id", *FLAGS]

    def known(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.withColumn("_key", _key("id")).where("_key is not null")
        return keyed.groupBy("_key").agg(F.max_by(F.struct(*fields), "ord").alias(name))

    apps, parts = known(applications, "a"), known(components, "c")
    met = asked.withColumn("_key", _key("app")).join(apps, "_key", "left").join(parts, "_key", "left")
    blank = F.greatest(*[F.col(f"a.{f}").isNull() for f in FLAGS])
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    parent = F.when(F.col("a").isNotNull() & blank, F.coalesce(named(F.col("a.parent_id")), named(F.col("c.parent_id")))).when(F.col("a").isNull(), named(F.col("c.parent_id")))
    met = met.withColumn("_up", _key(parent)).join(apps.select(F.col("_key").alias("_up"), F.col("a").alias("p")), "_up", "left")
    up = F.when(F.col("a").isNull() | (F.col("_up") != F.col("_key")), F.col("p"))
    met = met.withColumn("p", up).withColumn("own", F.coalesce("a", "c"))
    flags = [F.when(F.col("own").isNotNull(), F.coalesce(F.col(f"own.{f}"), F.col(f"p.{f}"), F.lit(False))).alias(f) for f in FLAGS]
    kind = F.when(F.col("a").isNotNull(), "application").when(F.col("c").isNotNull(), "component")
    source = F.when(F.col("p").isNotNull(), F.concat(kind, F.lit("->parent "), F.col("p.id"))).otherwise(kind)
    return met.select(*asked.columns, "own.id", "own.name", "own.parent_id", *flags, source.alias("source"))


def scope_paths(asked: DataFrame, files: DataFrame, tops: DataFrame, roots: list[str]) -> DataFrame:
    """Adds ``resolved`` and ``ambiguous`` to asked paths (scope, path): the file of ``files`` (scope, path) that is meant.

    Backslashes, ``./`` before a path, and one of ``roots`` before it, case aside, do not count.  A file of that very path
    holds; else the only one that has it below one of ``tops`` (scope, top).  Two or more are ambiguous, and none is taken.
    """
    plain = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    rel = plain
    for root in reversed([r.replace("\\", "/").rstrip("/") + "/" for r in roots]):
        rel = F.when(F.lower(plain).startswith(root.lower()), F.substring(plain, len(root) + 1, 1 << 30)).otherwise(rel)
    rows = asked.withColumn("_rel", rel)
    have = files.select("scope", F.col("path").alias("_file")).dropna().distinct()
    exact = have.select("scope", F.col("_file").alias("_rel"), F.col("_file").alias("_exact"))
    # a file offers what is below each of its leading folders; those that are top folders count
    parts = F.split("_file", "/")
    offered = have.select("scope", "_file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("top"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rel")))).alias("x")).select("scope", "_file", "x.*").where("rel != ''")
    below = offered.join(tops.select("scope", "top").distinct(), ["scope", "top"]).groupBy("scope", F.col("rel").alias("_rel")).agg(F.count("*").alias("_n"), F.min("_file").alias("_below"))
    met = rows.join(exact, ["scope", "_rel"], "left").join(below, ["scope", "_rel"], "left")
    none = F.col("_exact").isNull()
    out = met.withColumn("resolved", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_below")))).withColumn("ambiguous", none & F.coalesce(F.col("_n") > 1, F.lit(False)))
    return out.select(*asked.columns, "resolved", "ambiguous")
