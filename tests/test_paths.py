"""First paths and chunks against a search in plain Python; rounds that write once."""

import random

from pyspark.sql import functions as F

from sievemill.operators import graph, paths, rounds

EDGE, SINK = "scope long, caller string, callee string", "scope long, node string"


def searched(edges, start, goals, most):
    calls = {}
    for a, b in sorted(set(edges)):
        calls.setdefault(a, []).append(b)
    seen, level, out = {start}, [(start, [start])], []
    for _ in range(most):
        ahead = []
        for node, path in level:
            for to in calls.get(node, ()):
                if to not in seen:
                    seen.add(to)
                    ahead.append((to, [*path, to]))
        out += [x for x in ahead if x[0] in goals]
        level = ahead
    return [(i + 1, *x) for i, x in enumerate(out)]


def test_first_paths(spark):
    rnd = random.Random(4)
    names = [f"m/f{i}.c::é{i}" if i % 3 else f"b{i}" for i in range(25)]
    edges = {s: [(rnd.choice(names), rnd.choice(names)) for _ in range(45)] for s in (1, 2)}
    edges[2] += [(names[0], n) for n in names]  # a hub
    goals = {s: set(rnd.sample(names, 9)) for s in (1, 2)}
    rows = [(s, a, b) for s in edges for a, b in edges[s]]
    given = spark.createDataFrame(rows + rows[:9] + [(1, None, "x"), (None, names[0], names[1])], EDGE)
    starts = spark.createDataFrame([(s, n) for s in (1, 2) for n in names] + [(1, None), (3, "lone")], "scope long, start string")
    sinks = spark.createDataFrame([(s, g) for s in (1, 2) for g in goals[s]] + [(1, None)], SINK)
    for most in (1, 3, 8):
        got = sorted((r.scope, r.start, r.place, r.sink, tuple(r.path)) for r in paths.first_paths(given, starts, sinks, most).collect())
        want = sorted((s, n, i, to, tuple(p)) for s in (1, 2) for n in names for i, to, p in searched(edges[s], n, goals[s], most))
        assert got == want
    assert paths.first_paths(given.limit(0), starts, sinks).collect() == []


FILES = [(1, "a.c", 1000), (1, "b.c", 1500), (1, "c.c", 6000), (2, "a.c", 10)]
ENTRY = "scope long, ord long, file string, function string, kind string, open boolean"
SINKS = "scope long, ord long, file string, function string, line long"


def chunks(spark, edges, entries, sinks, **more):
    out = paths.path_chunks(spark.createDataFrame(edges, EDGE), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(sinks, SINKS), spark.createDataFrame(FILES, "scope long, path string, loc long"), **more)
    return sorted(out.collect(), key=lambda r: (r.scope, r.rank))


def test_chunks(spark):
    edges = [(1, "a.c::main", "b.c::mid"), (1, "b.c::mid", "c.c::run"), (1, "a.c::main", "gone.c::run2"), (1, "c.c::run", "a.c::main"), (2, "a.c::main", "a.c::end")]
    entries = [(1, 1, "a.c", "main", "cli", False), (1, 2, "a.c", "main", "network", True), (1, 3, "b.c", "other", "file", None), (2, 1, "a.c", "main", "cli", None), (1, 4, None, "x", "cli", True), (1, 5, "zzz.c", "nothing", "cli", True)]
    sinks = [(1, 1, "c.c", "run", 7), (1, 2, "c.c", "run", 9), (1, 3, "b.c", None, 3), (2, 1, "a.c", "end", 5), (1, 4, "gone.c", "run2", 1)]
    got = chunks(spark, edges, entries, sinks)
    assert [(r.scope, r.id, r.entry, r.path, r.files, r.sinks, r["size"]) for r in got] == [
        # the open entry's path first; the closed one with the same function, sink and files makes none
        (1, "taint-01", 2, ["main", "run2"], ["a.c"], "gone.c:1", "small"),
        (1, "taint-02", 2, ["main", "mid", "run"], ["a.c", "b.c", "c.c"], "c.c:7, c.c:9", "large"),
        (1, "taint-03", 3, ["other", "None"], ["b.c"], "b.c", "small"),
        (2, "taint-01", 1, ["main", "end"], ["a.c"], "a.c:5", "small"),
    ]
    assert got[0].hypothesis.startswith("Taint path: UNAUTH network input at main() [a.c] flows via main -> run2 to sink run2() [gone.c:1].")
    assert [r.id for r in chunks(spark, edges, entries, sinks, most=1) if r.scope == 1] == ["taint-01"]
    assert [r.sink for r in chunks(spark, edges, entries, sinks, most_hops=1) if r.scope == 1] == ["gone.c::run2", "b.c::None"]
    assert chunks(spark, [], [], []) == []


def test_rounds_write_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    once = rounds.written(spark.range(100).mapInArrow(count, "id long"))
    assert once.agg(F.sum("id")).first()[0] == 4950 and once.count() == 100
    assert ran.value == 100
    rounds.done_with(once)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "caller long, callee long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_components_send_no_table_through_the_driver(spark):
    from pyspark.sql import functions as F

    from sievemill.operators import graph

    plans, plain = [], graph.written
    graph.written = lambda df: plans.append(df._jdf.queryExecution().toString()) or plain(df)
    try:
        got = {r.node: r.component for r in graph.components(spark.range(1, 40).select(F.col("id").alias("caller"), (F.col("id") - F.col("id") % 10).alias("callee")).where("callee > 0")).collect()}
    finally:
        graph.written = plain
    assert got == {n: n - n % 10 for n in range(10, 40)}
    assert not any("Broadcast" in p for p in plans)


def test_first_paths_meet_only_what_leads_to_a_sink(spark, monkeypatch):
    """A hub's callees that lead to no sink in the calls left are on no level."""
    held = []
    monkeypatch.setattr(paths, "written", lambda df: held.append(rounds.written(df)) or held[-1])
    monkeypatch.setattr(paths, "done_with", lambda *tables: None)
    edges = [("a", f"x{i}") for i in range(50)] + [("a", "b"), ("b", "c"), ("c", "d"), ("x0", "x1"), ("x2", "c"), ("x3", "y"), ("y", "c")]
    given = spark.createDataFrame([(1, *e) for e in edges], EDGE)
    starts, sinks = spark.createDataFrame([(1, "a"), (1, "y"), (1, "x9")], "scope long, start string"), spark.createDataFrame([(1, "d")], SINK)
    got = sorted((r.start, r.place, r.sink, list(r.path)) for r in paths.first_paths(given, starts, sinks, 3).collect())
    assert got == [("a", 1, "d", ["a", "b", "c", "d"]), ("y", 1, "d", ["y", "c", "d"])]
    met = {(r.start, r.node) for df in held if {"start", "node"} <= set(df.columns) for r in df.select("start", "node").collect()}
    assert met == {("a", n) for n in ("a", "b", "x2", "c", "d")} | {("y", n) for n in ("y", "c", "d")}
