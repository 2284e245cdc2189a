"""Settings paths and call graphs: forms one by one, odd texts, and a plain search over whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions import keypaths
from sievemill.operators import callgraph, clusters

FILES = "scope long, path string, text string"


def shapes(spark, rows):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], "i long, text string, ending string").withColumn("paths", keypaths.key_paths("text", "ending"))
    return [(r.paths, r.shape) for r in df.select("i", "paths", keypaths.shape(F.col("paths")).alias("shape")).orderBy("i").collect()]


def test_key_paths(spark):
    rows = [
        ("a:\n  b: 1\n  - c: 2\n    d-e.f: x\n# g: 1\n\n h : 3\nno key\nz:", ".YML"),
        ("a:\r\n    b:\r\n  c: {x: 1}\u2028d: 1", ".yaml"),
        ('{"a": {"b": [1, {"c": []}, []], "d": {}}, "": {"e": null}}', ".json"),
        ("[]", ".json"), ("3", ".json"), ('{"a": 1', ".json"), ('{"a": 1, "a": {"b": 2}}', ".json"),
        ("[S]\nKey = 1\nflag\nkey: 2\n[T]\nx=%(nope)s", ".ini"), ("lost = 1\n[S]\na=1", ".conf"), ("[DEFAULT]\nall=1\n[S]\na=1", ".cfg"),
        (" a.b-c = 1\nd: 2\n#e=3\nf g=4\n\u00e9=1", ".properties"), ("", ".env"), (None, ".env"), ("a=1", None), ("[" * 100_000, ".json"),
    ]
    got = [p for p, _ in shapes(spark, rows)]
    assert got[0] == ["a", "a.b", "a.c", "a.c.d-e.f", "a.h", "z"]
    assert got[1] == ["a", "a.b", "a.c", "d"]
    assert got[2] == ["a.b[]", "a.b[].c", "a.b[]", "a.d", "e"]
    assert got[3:7] == [[""], [""], None, ["a.b"]]
    assert got[7:10] == [["S.key", "S.flag", "T.x"], None, ["S.a", "S.all"]]
    assert got[10:] == [["a.b-c", "d"], [], None, None, None]


def test_equal_shapes_hash_alike(spark):
    rows = [("a:\n  b: 1\n  c: 2", ".yml"), ("a:\n    c: x\n    b: {}\n# no\na:\n  b: 9", ".yml"), ('{"a": {"c": 0, "b": 5}}', ".json"), ("a: 1\nb: 2", ".yml"), ("", ".yml"), ("{", ".json")]
    found = [s for _, s in shapes(spark, rows)]
    assert found[0] == found[1] and found[0] not in found[2:4] and found[4:] == [None, None]
    files = spark.createDataFrame([(f"{env}/app.yml", f"a:\n  b: {i}\n") for i, env in enumerate(["x/dev", "x/prod", "x/qa", "x/perf"])] + [("lone.yml", "z: 1")], "path string, text string")
    files = files.select("path", F.length("text").alias("size"), keypaths.shape(keypaths.key_paths("text", F.lit(".yml"))).alias("shape"), F.array().cast("array<string>").alias("tokens"))
    roles = {r.path: r.role for r in clusters.reduce_shapes(files, 3).collect()}
    assert roles == {"x/prod/app.yml": "representative", "x/dev/app.yml": "dropped", "x/qa/app.yml": "dropped", "x/perf/app.yml": "dropped", "lone.yml": "small"}


LINES = [
    ("def run(a):", "run"), ("  async  def go (", "go"), ("export async function* gen (", "gen"), ("func (t *T) meth(", "meth"), ("func Id<T>(x)", "Id"), ("fn main() {", "main"), ("  sub call_me", "call_me"),
    ("@Override public static <T> List<T> of(T x);", "of"), ("unsigned int count(char *p) {", "count"), ("    get size() {", "size"), ("    if (x) {", None), ("return f(x) {", "f"), ("x = f(1);", None),
    ("def if(x):", None), ("  static make(a, b) {", "make"), ("def \u00e9t\u00e9(x):", "\u00e9t\u00e9"), ("int a(b; c) {", None), ("", None), (None, None), ("private int while(x)", None),
]


def test_defined_names(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "i long, line string")
    got = [r.name for r in df.select("i", callgraph.defined_name(F.col("line")).alias("name")).orderBy("i").collect()]
    assert got == [name for _, name in LINES]
    # and the rule of the first form in plain regular expressions
    for line, name in LINES:
        fits = [m[1] for form in callgraph.DEFINITIONS if (m := re.match(form, line or "")) and m[1] not in callgraph.NO_NAMES]
        assert (fits[0] if fits else None) == name


def plain_frontier(files, seeds, rounds, most_targets, most_names):
    """The same by going through all lines with one pattern of all names, as one would on one machine."""
    out = {}
    for scope in {s for s, _, _ in files}:
        texts = {p: re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", t) for s, p, t in files if s == scope and t is not None}
        whole = " ".join(t for s, _, t in files if s == scope and t)
        defs = {}
        for p, lines in texts.items():
            for i, line in enumerate(lines):
                fits = [m[1] for form in callgraph.DEFINITIONS if (m := re.match(form, line)) and m[1] not in callgraph.NO_NAMES]
                if fits:
                    defs[p, i] = fits[0]
        places = {}
        for (p, _), n in defs.items():
            places.setdefault(n, set()).add(p)
        seen = set(re.findall(r"\b([A-Za-z_]\w{2,})\s*\(", whole)) | set(places)
        names = {n for s, n in seeds if s == scope and n and len(n) >= 3 and n not in callgraph.NO_NAMES} & seen
        known = set(names)

        def files_of(name, caller):
            found = places.get(name, set())
            if caller in found:
                return [caller]
            shared = lambda f: next((i for i, (x, y) in enumerate(zip(f.split("/"), caller.split("/"), strict=False)) if x != y), 99)
            return sorted(found, key=lambda f: (-shared(f), f))[:most_targets]

        for n in range(1, rounds + 1):
            use = sorted(names, key=lambda x: (-len(x), x))[:most_names]
            names = set()
            if not use:
                break
            rx = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, use)) + r")\s*\(")
            for p, lines in texts.items():
                within = None
                for i, line in enumerate(lines):
                    within = defs.get((p, i), within)
                    for m in rx.finditer(line):
                        if within == m[1]:
                            continue
                        for f in files_of(m[1], p):
                            out.setdefault((scope, f"{p}::{within or callgraph.MODULE}", f"{f}::{m[1]}"), n)
                        if within and within not in known:
                            names.add(within)
            known |= names
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize("seed,most_names", [(1, 600), (2, 3), (3, 600)])
def test_frontier(spark, seed, most_names):
    rnd = random.Random(seed)
    words = [f"name{i}" for i in range(18)] + ["\u00e9cole", "ab", "longer_name"]
    forms = ["def {}(x):", "  y = {}(1) + {}(2)", "    {} ({}(3))", "fn {}", "x.{}\t(4)", "{} = 1", "static int {}(int a) {{"]
    files = []
    for scope in (1, 2):
        for i in range(12):
            lines = [rnd.choice(forms).format(rnd.choice(words), rnd.choice(words)) for _ in range(rnd.randint(0, 25))]
            files.append((scope, f"r{scope}/d{i % 3}/e{i % 2}/f{i}", rnd.choice(["\n", "\r\n", "\u2028"]).join(lines)))
    files += [(1, "r1/none", None), (2, "r2/empty", "")]
    seeds = [(s, rnd.choice(words)) for s in (1, 2) for _ in range(3)] + [(1, "unheard"), (1, "if"), (2, None)]
    df = spark.createDataFrame(files, FILES)
    got = callgraph.frontier(df, spark.createDataFrame(seeds, "scope long, name string"), 3, 2, most_names)
    assert sorted(map(tuple, got.collect())) == plain_frontier(files, seeds, 3, 2, most_names)
    assert callgraph.frontier(df.limit(0), spark.createDataFrame(seeds, "scope long, name string")).collect() == []


def test_qualified_edges(spark):
    files = [(1, "a/x", "def main():\n  helper(1)\n  lone(2)"), (1, "b/y", "def helper(x):"), (1, "b/z", "def helper(x):\ndef main():"), (2, "e", "")]
    edges = [(1, "zz::main", "q::helper"), (1, "main", "lone"), (1, "ghost", "helper"), (1, "main", "ghost"), (1, "lone", "helper"), (1, "", "helper"), (1, None, "x"), (2, "any", "thing")]
    got = callgraph.qualified_edges(spark.createDataFrame(edges, "scope long, caller string, callee string"), spark.createDataFrame(files, FILES), 2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, "a/x::main", "helper", "b/y::helper", None), (1, "a/x::main", "helper", "b/z::helper", None), (1, "b/z::main", "helper", "b/z::helper", None),
        (1, "a/x::main", "lone", None, "target"), (1, "b/z::main", "lone", None, "target"), (1, "ghost", "helper", None, "caller"), (1, "main", "ghost", None, "callee"),
        (1, "lone", "helper", "b/y::helper", None), (1, "lone", "helper", "b/z::helper", None), (2, "any", "thing", None, "target"),
    ], key=repr)


def test_settings_files_are_thinned_out(spark):
    from sievemill.operators import configs

    same, odd = "a:\n  b: {}\n", "a:\n  b: 1\ndebug: true\n"
    rows = [(1, i, f"svc{i % 2}/{env}/app{i}.yml", 10 + i, same.format(i)) for i, env in enumerate(["dev", "prod", "qa", "prod", "perf", "dev"])]
    rows += [(1, 20, "svc0/dev/x.yml", 5, odd), (1, 21, "readme.md", 5, "a: 1"), (1, 22, "svc0/big.yml", 10**7, same), (1, 23, "svc0/none.yml", 1, None), (1, 24, "svc0/.env", 1, "K=1"), (1, 25, "svc0/empty.yml", 1, ""), (2, 1, "lone/app.yml", 1, same)]
    done = configs.roles(spark.createDataFrame(rows, "scope long, ord long, path string, size long, text string"))
    role = {(r.scope, r.ord): r.role for r in done.collect()}
    assert role == {(1, 0): "dropped", (1, 1): "dropped", (1, 2): "dropped", (1, 3): "representative", (1, 4): "representative", (1, 5): "dropped", (1, 20): "small", (1, 21): "other", (1, 22): "unreadable", (1, 23): "unreadable", (1, 24): "other", (1, 25): "unreadable", (2, 1): "small"}
    total, top = configs.report(done)
    assert [tuple(r) for r in total.orderBy("scope").collect()] == [(1, 10, 3, 1, 2, 0, 4), (2, 1, 0, 0, 0, 0, 0)]
    (best,) = top.collect()
    assert (best.scope, best.place, best["size"], best.representatives, best.dropped, best.sample, len(best["shape"])) == (1, 1, 6, ["svc0/perf/app4.yml", "svc1/prod/app3.yml"], 4, "svc1/prod/app3.yml", 12)
    assert configs.roles(done.select("scope", "ord", "path", "size", F.lit(None).cast("string").alias("text")).limit(0)).collect() == []


def test_names_beyond_ascii_and_of_lines_that_fit_no_form(spark):
    text = "def größe(a):\n  x = añadir (1)\nfn sub_(x) { kurz(1) }\nundefined(1)\nexport function* zwei(a) {\npublic int drei(int a)\nint vier(int a) {"
    got = callgraph.function_lines(spark.createDataFrame([(1, "a", text), (1, "b", None)], FILES)).collect()
    assert [(r["line"], r["name"], r["calls"]) for r in sorted(got, key=lambda r: r["line"])] == [
        (1, "größe", ["größe"]), (2, None, ["añadir"]), (3, "sub_", ["sub_", "kurz"]), (4, None, ["undefined"]), (5, "zwei", ["zwei"]), (6, "drei", ["drei"]), (7, "vier", ["vier"]),
    ]


def test_names_take_one_pass(spark):
    """Each form is searched once in a line: neither a filter on rows nor a condition repeats it."""
    plan = callgraph.definitions(spark.createDataFrame([(1, "a", "def f(x):")], FILES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"def\s+(\w+)") == 2  # with and without Unicode classes


def test_key_paths_of_many_texts_stand_in_their_rows(spark):
    rows = [(i, None if i % 7 == 3 else f"a{i}: 1\nb:\n  c{i}: 2") for i in range(200)]
    got = spark.createDataFrame(rows, "i long, text string").coalesce(1).select("i", keypaths.key_paths("text", F.lit(".yml")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: None if t is None else [f"a{i}", "b", f"b.c{i}"] for i, t in rows}
    assert keypaths._ROWS < 200


def test_frontier_looks_for_every_name(spark):
    """More names than the six hundred that a round once went on with: none is left out, and each bears its round."""
    text = "".join(f"def top{i}(x):\n  mid{i}(1)\ndef mid{i}(x):\n  low{i}(2)\n" for i in range(700))
    df = spark.createDataFrame([(1, "a/x", text)], FILES)
    got = callgraph.frontier(df, spark.createDataFrame([(1, f"mid{i}") for i in range(700)], "scope long, name string"), 2).collect()
    assert sorted((r.caller, r.callee, r["round"]) for r in got) == sorted((f"a/x::top{i}", f"a/x::mid{i}", 1) for i in range(700))


def test_texts_are_read_in_one_pass(spark):
    """Names that a bracket follows on the next line are known but not called, as one line after the other tells it."""
    text = "def run(a):\n  if (go(1)) {\n  later\n (2)\nrun(3)\ndef go(x):\n  go(1); été(2); ab(3)"
    (r, none) = sorted(callgraph.texts_read(spark.createDataFrame([(1, "a", text), (1, "b", None)], FILES)).collect(), key=lambda r: r["path"])
    assert (r.defined, sorted(r.known)) == (["run", "go"], ["go", "later", "run"])
    assert list(zip(r.within, r.name, r.own, strict=True)) == [("run", "go", True), ("go", "été", False), ("go", "ab", False)]
    assert none.defined == none.known == none.name == []
