"""Edges of the matching, grouping and state operators that the queries do not reach."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from sievemill.functions import status
from sievemill.operators import clusters, matching, state


def test_calls_prefer_own_file_then_folders(spark):
    calls = spark.createDataFrame([("f", "a/b/x.c"), ("f", "z/q.c"), ("g", "a/b/x.c"), (None, "a/x.c"), ("h", "a/x.c")], "name string, caller_file string")
    defs = spark.createDataFrame([("f", "a/b/x.c"), ("f", "a/y.c"), ("g", "c/u.c"), ("g", "a/c/v.c"), ("g", "a/b/w.c"), ("g", "a/a.c")], "name string, file string")
    got = {(r.name, r.caller_file, r.place): r.file for r in matching.resolve_calls(calls, defs).collect()}
    assert got == {("f", "a/b/x.c", 1): "a/b/x.c", ("f", "z/q.c", 1): "a/b/x.c", ("f", "z/q.c", 2): "a/y.c",
                   ("g", "a/b/x.c", 1): "a/b/w.c", ("g", "a/b/x.c", 2): "a/a.c", ("g", "a/b/x.c", 3): "a/c/v.c"}


def test_titles_refuse_to_guess(spark):
    h = spark.createDataFrame([(1, "SQL injection"), (2, "sql injection in reports "), (3, "Leak"), (4, None), (5, "twice")], "repo int, title string").withColumn("repo", F.lit(1))
    r = spark.createDataFrame([(1, 10, "SQL injection"), (1, 11, "leak of keys"), (1, 12, "leak of names"), (1, 13, "twice"), (1, 14, "Twice"), (2, 15, "leak")], "repo int, id int, title string")
    got = {x.title: x.report for x in matching.match_titles(h, r, "repo").collect()}
    assert got == {"SQL injection": 10, "sql injection in reports ": 10, "Leak": None, None: None, "twice": None}


def test_shapes_match_a_walk_in_order(spark):
    import random

    rnd = random.Random(3)
    files = [(f"s{i % 3}", f"{rnd.choice('ab')}{rnd.choice(['/prod', '/qa', ''])}/{i}.ini", rnd.randrange(5), rnd.sample("abcdefghij", rnd.randrange(4))) for i in range(60)]
    files += [("tiny", "x/1", 1, ["a"]), ("tiny", "x/2", 1, None), ("s0", "a/none", 0, None)]
    rank = lambda p: 0 if "/prod" in p else 2 if "/qa" in p else 3
    want = {}
    for shape in {f[0] for f in files}:
        rows = sorted((f for f in files if f[0] == shape), key=lambda f: (rank(f[1]), -f[2], f[1]))
        tops, seen = {}, set()
        for f in rows:
            tops.setdefault(f[1].split("/")[0], f)
        for f in tops.values():
            seen |= set(f[3] or [])
        for f in rows:
            new = set(f[3] or []) - seen
            if len(rows) < 4:
                want[shape, f[1]] = ("small", None)
            elif f in tops.values():
                want[shape, f[1]] = ("representative", None)
            elif f[3] is None:
                want[shape, f[1]] = ("promoted", None)
            else:
                want[shape, f[1]] = ("promoted", min(new)) if new else ("dropped", None)
                seen |= new
    df = spark.createDataFrame(files, "shape string, path string, size int, tokens array<string>")
    assert {(r["shape"], r.path): (r.role, r.token) for r in clusters.reduce_shapes(df, 4).collect()} == want


def test_saved_steps_come_back_only_if_they_parse(spark, tmp_path):
    folder = str(tmp_path / "state")
    rows = [("r", "a", '{"n": 1}', 1), ("r", "a", '{"n": 2}', 2), ("r", "bad", "{", 1), ("r", "odd", '{"n": "x"}', 1), ("q", "a", '{"n": 9}', 5), ("q", None, "{}", 1)]
    state.save(spark.createDataFrame(rows, "run_id string, step string, payload string, seq long"), folder)
    schema = StructType().add("n", IntegerType(), False)
    read = lambda run, step: [r.n for r in state.load(spark, folder, run, step, schema).collect()]
    assert [read("r", "a"), read("q", "a"), read("r", "bad"), read("r", "odd"), read("r", "none")] == [[2], [9], [], [], []]


def test_typed_selection(spark):
    cases = {"2-3, 9 1": [1, 2, 0], "1-99999999999": [0, 1, 2], "3-1": [], "-2 x 2-": [], "PENDING": [0, 2], " quit ": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", status.selected(F.col("t"), F.array(*[F.lit(i) for i in (1, 2, 3)]), F.array(F.lit(False), F.lit(True), F.lit(False))).alias("p")).collect()
    assert {r.t: r.p for r in got} == cases


def test_typed_selection_works_out_what_is_known_once_a_row(spark):
    known, done = (F.transform(F.sequence(F.lit(1), F.lit(12)), f) for f in (lambda i: i * 3, lambda i: i % 2 == 0))
    df = spark.createDataFrame([("1-9 36,3 3", 1), ("40 x 5-", 2), ("12-1", 3)], "t string, n int").select("n", status.selected(F.col("t"), known, done).alias("p"))
    assert df._jdf.queryExecution().analyzed().toString().count("sequence(1, 12") <= 3
    assert {r.n: r.p for r in df.collect()} == {1: [0, 1, 2, 11], 2: [], 3: []}
    none = spark.createDataFrame([("1-9", None)], "t string, k array<int>")
    assert none.select(status.selected(F.col("t"), F.col("k"), F.col("k").cast("array<boolean>")).alias("p")).first().p == []


def test_paths_arguments_and_logs(spark):
    from sievemill.functions import commands, judgement

    paths = {"x/../y": "/r/y", "..": None, "../r/z": "/r/z", "/r": "/r", "/rr": None, None: None}
    got = spark.createDataFrame([(k,) for k in paths], "p string").select("p", commands.within(F.col("p"), "/r").alias("q")).collect()
    assert {r.p: r.q for r in got} == paths
    argv = spark.createDataFrame([(["--token"],), (["--token", "--pwd", "x", "--auth=a=b"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in argv.select(commands.without_secrets(F.col("a"))).collect()] == [["--token"], ["--token", "--pwd", "***", "--auth=***"], [], None]
    logs = {"$ a\n[rc=1]\n==1==ERROR: AddressSanitizer: x\nSUMMARY: AddressSanitizer: x": True, "$ a\n[rc=0]\nERROR: AddressSanitizer:\nSUMMARY: AddressSanitizer:": False, "": False, None: False}
    got = spark.createDataFrame([(k,) for k in logs], "t string").select("t", commands.real_crash(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == logs
    texts = {"password = 'hunter2hunter2'": ["secret:password = 'hunter2hunter2"], "password: ${ENV_VALUE}": [], "secret: vault:abcdefgh": [], "verify =  false": ["insecure:verify = false"], None: []}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", judgement.suspicious(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == texts


def test_empty_tables_give_no_rows(spark):
    from sievemill.operators import coverage

    none = lambda schema: spark.createDataFrame([], schema)
    out = [
        matching.resolve_calls(none("name string, caller_file string"), none("name string, file string")),
        matching.chain_steps(none("chain long, steps array<long>"), none("ord long, place long")),
        clusters.cohesive(none("path string"), none("module string, ord long, path string"), none("caller string, callee string")),
        clusters.edge_lines(none("graph long, ord long, caller string, callee string"), none("graph long, function string")),
        coverage.match_nodes(none("file string, name string"), none("node string")),
        coverage.hop_files(none("path long, ord long, file string"), none("path long, file string"), 3),
    ]
    assert [df.count() for df in out] == [0] * len(out)


def test_titles_that_contain_each_other(spark):
    """Against all pairs: short and long texts, stretches that everything has, and a text that is its own stretch."""
    import random

    rnd = random.Random(9)
    words = ["sql", "a", "injection", "in", "the", "report", "of", "é", "x" * 12, ""]
    title = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5)))
    heads = [(s, i, title()) for s in (1, 2) for i in range(60)] + [(1, 99, None), (3, 1, "lone")]
    reports = [(s, i, title()) for s in (1, 2) for i in range(60)] + [(1, 99, None)]
    got = matching.match_titles(spark.createDataFrame(heads, "scope long, n long, title string"), spark.createDataFrame(reports, "scope long, id long, title string"), "scope")
    norm = lambda t: (t or "").strip(" ").lower()
    want = {}
    for s, n, t in heads:
        known = [(i, norm(r)) for q, i, r in reports if q == s and norm(r)]
        same = [i for i, r in known if r == norm(t)]
        near = [i for i, r in known if norm(t) and (r in norm(t) or norm(t) in r)]
        want[s, n] = (same[0] if len(same) == 1 else None) if same else near[0] if len(near) == 1 else None
    assert {(r.scope, r.n): r.report for r in got.collect()} == want
    assert any(want.values())


def test_results_by_their_beginning(spark):
    reports = [(1, 1, None, None, "Leak"), (1, 2, "a.c", 3, "x"), (1, 3, None, None, "Leak of keys"), (2, 4, None, None, "Leak"), (1, 5, None, None, " "), (1, 6, None, None, "Leaks")]
    results = [(1, 10, "b.c", 1, "Leak of keys in b"), (1, 11, "a.c", 3, "other"), (1, 12, "c.c", 1, "Leak"), (2, 13, "c.c", 1, None)]
    args = spark.createDataFrame(reports, "scope long, id long, file string, line_start long, title string"), spark.createDataFrame(results, "scope long, ord long, file string, line long, text string")
    assert {r.id: (r.result, r.how) for r in matching.match_results(*args, "scope").collect()} == {1: (10, "title"), 2: (11, "place"), 3: (10, "title"), 4: (None, None), 5: (None, None), 6: (None, None)}
    assert {r.id: r.result for r in matching.match_results(*args, "scope", unique=True).collect()} == {1: None, 2: 11, 3: 10, 4: None, 5: None, 6: None}


def test_texts_offer_only_stretches_that_may_be_asked_for(spark, monkeypatch):
    """A long text offered each of its stretches of each asked length; few of them end as one that is asked for does."""
    long = spark.createDataFrame([(1, "title <123456>")], "k long, long string")
    asked = spark.createDataFrame([(1, "<7>"), (1, "<77>"), (1, "<123456>")], "k long, _gram string")
    assert [r["_gram"] for r in matching._held(asked, long, "k").collect()] == ["<123456>"]
    short = spark.createDataFrame([(1, "<123456>"), (1, "<7>"), (1, "title"), (2, "title"), (1, "")], "k long, short string")
    for few, ends in ((64, 100), (0, 100), (0, 0)):
        monkeypatch.setattr(matching, "_FEW", few)
        monkeypatch.setattr(matching, "_ENDS", ends)
        assert sorted(r.short for r in matching.containing(short, long, "k").collect()) == ["<123456>", "title"]


def test_no_paths_of_cohesive_files_are_broadcast(spark):
    """Tables of paths were broadcast, through the driver, as long as they shuffled to less than the broadcast threshold."""
    import io
    from contextlib import redirect_stdout

    files = spark.range(40).select(F.concat(F.lit("a/b/f"), F.col("id").cast("string")).alias("path"))
    modules = files.limit(5).select(F.lit("m").alias("module"), F.lit(1).cast("long").alias("ord"), "path")
    edges = files.select(F.col("path").alias("caller"), F.concat(F.col("path"), F.lit("0")).alias("callee"))
    out = clusters.cohesive(files, modules, edges)
    assert out.count() == 40
    said = io.StringIO()
    with redirect_stdout(said):
        out.explain()
    assert "Broadcast" not in said.getvalue()


def test_files_of_a_path_are_dealt_once(spark):
    """Candidates were shuffled by path and file, by path and lead and by path again, each lead on a row of its own."""
    import io
    from contextlib import redirect_stdout

    from sievemill.operators import coverage

    files = spark.createDataFrame([(1, 1, "a/b/x"), (1, 2, "a/c/y"), (1, 3, "z"), (1, 0, "z"), (1, 4, "a/c"), (2, 9, "q"), (2, 5, "r"), (3, 1, "b"), (3, 2, "a"), (3, 0, None)], "path long, ord long, file string")
    anchors = spark.createDataFrame([(1, "a/c/w"), (1, "a/c/w"), (1, "b/x"), (2, ""), (3, None)], "path long, file string")
    out = coverage.hop_files(files, anchors, 2)
    said = io.StringIO()
    with redirect_stdout(said):
        out.explain()
    assert said.getvalue().count("Exchange") == 2 and "Generate" not in said.getvalue()
    assert {(r.path, r.place): r.file for r in out.collect()} == {(1, 1): "a/c", (1, 2): "a/c/y", (2, 1): "r", (2, 2): "q", (3, 1): None, (3, 2): "a"}


def test_callers_of_a_folder_share_their_nearest_files(spark):
    calls = spark.createDataFrame([(1, "f", "a/b/x"), (1, "f", "a/b/y"), (1, "f", "top"), (2, "f", "a/b/x"), (1, "f", None)], "scope long, name string, caller_file string")
    defs = spark.createDataFrame([(1, "f", f) for f in ("a/b/y", "a/c/1", "a/c/2", "a/c/3", "z", "a/b/k/1")] + [(1, "g", "a/b/x"), (2, "f", "q/w")], "scope long, name string, file string")
    got = sorted((r.scope, r.caller_file, r.place, r.file) for r in matching.resolve_calls(calls, defs, 2, ["scope", "name"]).collect())
    assert got == [(1, "a/b/x", 1, "a/b/k/1"), (1, "a/b/x", 2, "a/b/y"), (1, "a/b/y", 1, "a/b/y"), (1, "top", 1, "a/b/k/1"), (1, "top", 2, "a/b/y"), (2, "a/b/x", 1, "q/w")]
