"""Parts of chunks: single files beyond the bound, groups that don't mix, order, characters instead of lines."""

from sievemill.operators import chunks, windows

FILES = "scope long, chunk string, ord long, path string, loc long, chars long"


def parts(spark, files, modules=(), edges=(), **more):
    df = spark.createDataFrame(files, FILES)
    mods = spark.createDataFrame(list(modules), "scope long, ord long, place long, path string")
    calls = spark.createDataFrame(list(edges), "scope long, caller string, callee string")
    return {(r.scope, r.id): (r.files, r.loc, r["size"]) for r in chunks.split(df, mods, calls, **more).collect()}


def test_parts(spark):
    files = [(1, "big", i, p, loc, 10) for i, (p, loc) in enumerate([("z/m2.c", 50), ("a.c", 900), ("src/x/b.c", 10), ("src/x/c.c", 10), ("lib/call1.c", 5), ("web/call2.c", 5), ("z/m1.c", 50), ("far.c", None), ("src/x/d.c", 995)])]
    files += [(1, "ok", 1, "src/x/b.c", 10, 1), (1, "ok", 0, "q.c", 10, 1), (2, "big", 0, "huge.c", 5000, 1)]
    modules = [(1, 7, 0, "z/m2.c"), (1, 7, 1, "z/m1.c"), (1, 9, 0, "z/m1.c"), (2, 1, 0, "a.c")]
    edges = [(1, "lib/call1.c", "web/call2.c"), (1, "far.c", "else.c"), (1, "a.c", "a.c"), (1, "z/m1.c", "src/x/b.c"), (2, "a.c", "src/x/b.c")]
    got = parts(spark, files, modules, edges, most_loc=1000, most_files=25)
    assert got == {
        (1, "big-a"): (["z/m2.c", "z/m1.c"], 100, "small"), (1, "big-b"): (["far.c"], 0, "small"), (1, "big-c"): (["lib/call1.c", "web/call2.c"], 10, "small"), (1, "big-d"): (["src/x/b.c"], 10, "small"),
        (1, "big-e"): (["a.c"], 900, "small"), (1, "big-f"): (["src/x/c.c"], 10, "small"), (1, "big-g"): (["src/x/d.c"], 995, "small"),
        (1, "ok"): (["q.c", "src/x/b.c"], 20, "small"), (2, "big-a"): (["huge.c"], 5000, "medium"),
    }
    # a file that a module's file calls stands alone, as its partner is not pending
    many = parts(spark, [(1, "c", i, f"d/e/f{i:02}.c", 1, 100) for i in range(30)], most_loc=1000, most_files=1)
    assert len(many) == 30 and many[1, "c-z"][0] == ["d/e/f25.c"] and many[1, "c-27"][0] == ["d/e/f26.c"]
    chars = parts(spark, [(1, "c", i, f"f{i}", 9000, 100) for i in range(4)], most_chars=250)
    assert chars == {(1, "c-a"): (["f0", "f1"], 18000, "large"), (1, "c-b"): (["f2", "f3"], 18000, "large")}
    assert parts(spark, []) == {}


def test_pack_in_one_pass(spark):
    rows = [("hot", i, i % 7) for i in range(5000)] + [("b", 1, None), ("b", 2, 99), ("b", 3, 1), (None, 1, 3), (None, 2, 3)]
    got = windows.pack_in_order(spark.createDataFrame(rows, "g string, ord long, size long").repartition(5), "g", 10, 3).collect()
    want, state = {}, {}
    for g, o, size in rows:
        shard, total, n = state.get(g, (0, 0, 0))
        size = size or 0
        state[g] = (shard, total + size, n + 1) if n and n < 3 and total + size <= 10 else (shard + 1, size, 1)
        want[g, o] = state[g][0]
    assert {(r.g, r.ord): r.shard for r in got} == want
