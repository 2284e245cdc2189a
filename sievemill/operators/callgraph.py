"""Call graphs from source texts: where functions are defined and called, and edges that grow from names to their callers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions import names
from sievemill.operators import matching
from sievemill.operators.rounds import written

# Forms of a line that defines a function, the first that fits counts; words that are no name.
DEFINITIONS = [
    r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    r"^\s*(?:export\s+)?(?:async\s+)?function\*?\s+(\w+)\s*\(",
    r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(<]",
    r"^\s*fn\s+(\w+)",
    r"^\s*sub\s+(\w+)",
    r"^\s*(?:@\w+\s*)?(?:(?:public|private|protected|internal|static|final|override|virtual|abstract|async|synchronized|native|inline|extern)\s+)+[\w<>\[\],.?*&\s]+?\b(\w+)\s*\(",
    r"^\s*(?:[\w*&:]+\s+){1,2}(\w+)\s*\([^;()]*\)\s*\{",
    r"^\s{2,}(?:async\s+|static\s+|get\s+|set\s+)?(\w+)\s*\([^;()]*\)\s*\{",
]
#: What a line must have for the form of the same place to fit; most lines are passed by without a search.
NEEDED = ["def", "function", "func", "fn", "sub", "(", "{", "{"]
NO_NAMES = [
    "if", "for", "while", "switch", "catch", "return", "throw", "new", "else", "do", "try", "with", "using", "lock", "super", "this", "typeof", "delete",
    "sizeof", "instanceof", "synchronized", "yield", "await", "assert", "print",
]
MODULE = "<module>"
LEAST = 3

_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# a name's letters are taken as a whole: a shorter name would have a letter where the bracket must be
_CALL = r"(?<!\w)(\w++)\s*+\("
_CALLED = r"\b([A-Za-z_]\w{2,}+)\s*+\("
#: Texts that are read at once.
_TEXTS = 256


def defined_name(line: Column) -> Column:
    """The name of the function that a line defines, else null; a form that gives a word that is no name does not fit."""
    def first(flags: str) -> Column:
        # each form is tried once, and none after the one that fits
        name = lambda form: F.get(F.filter(F.array(F.regexp_extract(line, flags + form, 1)), lambda x: (x != "") & ~x.isin(NO_NAMES)), F.lit(0))
        return F.coalesce(*(F.when(F.contains(line, F.lit(needed)), name(form)) for form, needed in zip(DEFINITIONS, NEEDED, strict=True)))

    return F.when(_ascii(line), first("")).otherwise(first("(?U)"))


def _ascii(text: Column) -> Column:
    """Whether a text has ASCII letters only: there Unicode classes tell the same, but take several times as long."""
    return F.octet_length(text) == F.length(text)


def _names(text: Column, form: str) -> Column:
    return F.when(_ascii(text), F.regexp_extract_all(text, F.lit(form), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit("(?U)" + form), F.lit(1)))


def function_lines(files: DataFrame) -> DataFrame:
    """(scope, path, line, name, calls): lines of ``files`` (scope, path, text) that define a function or call names.

    ``calls`` holds the names before an opening bracket, in order, repeats included.  Null texts have no lines.
    """
    # only these can fit any form: most lines of a text are passed by at once
    may = lambda said: F.contains(said, F.lit("(")) | F.contains(said, F.lit("fn")) | F.contains(said, F.lit("sub")) | F.contains(said, F.lit("func"))
    told = lambda said, n: F.when(may(said), F.struct((n + 1).alias("line"), defined_name(said).alias("name"), _names(said, _CALL).alias("calls")))
    # within the array, as a filter on rows would work names and calls out again
    found = F.filter(F.transform(F.split("text", _LINE_ENDS), told), lambda x: x["name"].isNotNull() | (F.size(x["calls"]) > 0))
    return files.select("scope", "path", F.inline(found))


def definitions(files: DataFrame) -> DataFrame:
    """(scope, path, line, name) of every function that a line defines."""
    return function_lines(files).where("name is not null").select("scope", "path", "line", "name")


_SEARCHED, _CALLS, _KNOWN = [(re.compile(form), needed) for form, needed in zip(DEFINITIONS, NEEDED, strict=True)], re.compile(_CALL), re.compile(_CALLED)


def _read_text(text: str | None) -> tuple[list, ...]:
    """What a text defines, knows and calls, as :func:`texts_read` tells it."""
    within, over = None, False
    defined, known, pairs = {}, {}, {}
    for line in (text or "").splitlines():
        bracket = "(" in line
        if not (bracket or "fn" in line or "sub" in line):
            continue
        for form, needed in _SEARCHED:
            if needed in line and (m := form.match(line)) and m[1] not in NO_NAMES:
                within = defined[m[1]] = m[1]
                break
        if bracket:
            over = over or line.lstrip()[0] == "("
            for c in _CALLS.findall(line):
                if len(c) >= LEAST and (c[0] == "_" or (c[0].isascii() and c[0].isalpha())):
                    known[c] = None
                if c != within and c not in NO_NAMES:
                    pairs[within, c] = None
    if over:
        known.update(dict.fromkeys(_KNOWN.findall(text)))
    known.update(defined)
    return list(defined), list(known), [w for w, _ in pairs], [c for _, c in pairs], [c in defined for _, c in pairs]


def texts_read(files: DataFrame) -> DataFrame:
    """(scope, path, defined, known, within, name, own): what each text of ``files`` (scope, path, text) defines and calls.

    ``defined`` holds the names of its functions, ``known`` these and all names it calls, also over a line's end.  ``within``,
    ``name`` and ``own`` stand side by side: the last function defined at or before a call (null: none), the name called, and
    whether the text defines it; each pair once, without words that are no name and calls from a function of their name.
    Each text is gone through once.
    """
    rows = files.select("scope", "path", "text")
    many = T.ArrayType(T.StringType())
    lists = [("defined", many), ("known", many), ("within", many), ("name", many), ("own", T.ArrayType(T.BooleanType()))]
    schema = T.StructType([rows.schema["scope"], rows.schema["path"], *(T.StructField(n, t) for n, t in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                columns = zip(*map(_read_text, part.column(2).to_pylist()), strict=True)
                kinds = [pa.list_(pa.bool_() if n == "own" else pa.string()) for n, _ in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def _defined(read: DataFrame) -> DataFrame:
    return read.select("scope", "path", F.explode("defined").alias("name"))


def _known(read: DataFrame) -> DataFrame:
    return read.select("scope", F.explode("known").alias("name")).distinct()


def frontier(files: DataFrame, seeds: DataFrame, rounds: int = 3, most_targets: int = 3, most_names: int | None = None) -> DataFrame:
    """(scope, caller, callee, round): calls of the seeds' names, then of the functions that call them, and so on.

    ``files`` (scope, path, text), ``seeds`` (scope, name).  A round looks for the names that the one before has found
    calling: all of them, or with ``most_names`` so many a scope, the longest first, then by name; names of less than three
    letters and words that are no name are no seeds, nor are names that no text calls or defines.  A call belongs to the
    last function of its text defined at or before its line, else to ``<module>``; a call from a function of its own name is
    none.  Callee files are the caller's own, the only one, or the ``most_targets`` nearest.  Ends are ``path::name``; an
    edge bears the first round that finds it.

    Each text is read once.  A name is looked for in one round only, so rounds go over names alone, and calls meet the
    names' rounds and files at the end.
    """
    read = written(texts_read(files))
    sites = read.where("path is not null").select("scope", "path", F.inline(F.arrays_zip("within", "name", "own")))
    links = written(sites.where("within is not null").select("scope", "name", "within").distinct())
    good = seeds.select("scope", "name").where((F.length("name") >= LEAST) & ~F.col("name").isin(NO_NAMES)).dropna().distinct()
    longest = Window.partitionBy("scope").orderBy(F.desc(F.length("name")), "name")
    first = lambda rows: rows if most_names is None else rows.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= most_names).drop("_n")
    known = targets = written(good.join(_known(read), ["scope", "name"], "left_semi"))
    asked = None
    for n in range(1, max(1, rounds) + 1):
        now = first(targets).select("scope", "name", F.lit(n).alias("round"))
        asked = now if asked is None else asked.unionByName(now)
        if n < rounds:
            new = links.join(now, ["scope", "name"], "left_semi").select("scope", F.col("within").alias("name")).distinct()
            targets = written(new.join(known, ["scope", "name"], "left_anti"))
            if targets.isEmpty():
                break
            known = known.unionByName(targets)
    hits = sites.join(written(asked), ["scope", "name"]).withColumn("folder", matching.folder_of("path"))
    ends = written(matching.nearest_definitions(hits.where("not own").select("scope", "name", "folder"), _defined(read).withColumnRenamed("path", "file"), most_targets, ["scope", "name"]))
    near = hits.where("not own").join(ends.drop("place"), ["scope", "name", "folder"]).unionByName(hits.where("own").withColumn("file", F.col("path")))
    return near.select("scope", names.qualify(F.col("path"), F.coalesce("within", F.lit(MODULE))).alias("caller"), names.qualify(F.col("file"), F.col("name")).alias("callee"), "round")


def qualified_edges(edges: DataFrame, files: DataFrame, most_targets: int = 3) -> DataFrame:
    """(scope, caller, callee, target, reason): given edges checked against texts, with files to both ends.

    ``edges`` (scope, caller, callee): what stands before the last ``::`` of a name is not trusted and goes; blank ends
    take no part.  ``reason`` tells why an edge is dropped: ``caller`` or ``callee`` is neither called nor defined in the
    scope's texts, or ``target``: the callee is defined nowhere.  Otherwise ``caller`` is ``path::name`` for each of its
    first ``most_targets`` files (the bare name without any) and ``target`` the callee with each of its files.  A scope
    without any known name is not checked for names.
    """
    bare = lambda c: F.when(F.col(c) != "", names.qualified_name(F.col(c)))
    given = edges.select("scope", bare("caller").alias("caller"), bare("callee").alias("callee")).dropna().distinct()
    read = written(texts_read(files))
    defined = written(_defined(read).distinct())
    seen = written(_known(read))
    checked = seen.select("scope").distinct().withColumn("_any", F.lit(True))
    mark = lambda side: seen.select("scope", F.col("name").alias(side), F.lit(True).alias(f"_{side}"))
    met = given.join(checked, "scope", "left").join(mark("caller"), ["scope", "caller"], "left").join(mark("callee"), ["scope", "callee"], "left")
    reason = F.when(F.col("_any") & F.col("_caller").isNull(), "caller").when(F.col("_any") & F.col("_callee").isNull(), "callee")
    met = met.select("scope", "caller", "callee", reason.alias("reason"))
    order = Window.partitionBy("scope", "name").orderBy("path")
    firsts = written(defined.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_targets).drop("_n"))
    good = written(met.where("reason is null").join(firsts.select("scope", F.col("name").alias("caller"), "path"), ["scope", "caller"], "left").select("scope", "caller", "callee", "path"))
    calls = good.select("scope", F.col("callee").alias("name"), F.col("path").alias("caller_file")).dropna()
    near = matching.resolve_calls(calls, defined.withColumnRenamed("path", "file"), most_targets, ["scope", "name"]).select("scope", F.col("name").alias("callee"), F.col("caller_file").alias("path"), "file")
    placed = good.where("path is not null").join(near, ["scope", "callee", "path"], "left")
    lone = good.where("path is null").join(firsts.select("scope", F.col("name").alias("callee"), F.col("path").alias("file")), ["scope", "callee"], "left")
    both = placed.unionByName(lone, allowMissingColumns=True)
    at = F.when(F.col("path").isNull(), F.col("caller")).otherwise(names.qualify(F.col("path"), F.col("caller")))
    kept = both.select("scope", at.alias("caller"), "callee", names.qualify(F.col("file"), F.col("callee")).alias("target"), F.when(F.col("file").isNull(), "target").alias("reason"))
    dropped = met.where("reason is not null").select("scope", "caller", "callee", F.lit(None).cast("string").alias("target"), "reason")
    return kept.unionByName(dropped)
