"""Lookups by normalized ids, scope paths, score order and the policy gate on odd rows."""

from sievemill.operators import filters, joins, ranking

APP = "ord long, id string, name string, parent_id string, external boolean, pci boolean, pan boolean, pii boolean"


def test_lookup(spark):
    apps = [(1, "007", "old", None, True, True, True, True), (2, "7", "new", "9", None, False, False, False), (3, "9", "up", None, True, True, None, None), (4, "5", "self", "05", None, None, None, None), (5, " ", "blank", None, True, True, True, True), (6, "6", "full", "9", False, False, False, False)]
    parts = [(1, "7", "part", "9", True, None, None, None), (2, "8", "comp", "9", None, None, True, None), (3, "3", "lone", "404", None, None, None, True), (4, "5", "p5", "9", None, None, None, None)]
    asked = [("0007",), ("8",), ("3",), ("5",), ("6",), ("1",), (None,), ("",)]
    got = joins.lookup_apps(spark.createDataFrame(asked, "app string"), spark.createDataFrame(apps, APP), spark.createDataFrame(parts, APP))
    assert {r.app: (r.name, r.external, r.pci, r.pan, r.pii, r.source) for r in got.collect()} == {
        "0007": ("new", True, False, False, False, "application->parent 9"), "8": ("comp", True, True, True, False, "component->parent 9"), "3": ("lone", False, False, False, True, "component"),
        # its own parent is itself, which is no parent; the component's does not count then
        "5": ("self", False, False, False, False, "application"), "6": ("full", False, False, False, False, "application"), "1": (None,) * 6, None: (None,) * 6, "": (None,) * 6,
    }


def test_scope_paths(spark):
    files = spark.createDataFrame([(1, "a/x.c"), (1, "b/x.c"), (1, "a/y.c"), (1, "x.c"), (1, "a/b/z.c"), (2, "a/x.c"), (2, "a/x.c")], "scope long, path string")
    tops = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, "a/b"), (2, "a")], "scope long, top string")
    asked = spark.createDataFrame([(1, "x.c"), (1, ".\\./y.c"), (1, "y.c"), (1, "/R/a\\y.c"), (1, "z.c"), (2, "x.c"), (2, "no.c"), (2, None)], "scope long, path string")
    got = {(r.scope, r.path): (r.resolved, r.ambiguous) for r in joins.scope_paths(asked, files, tops, ["/r"]).collect()}
    assert got == {(1, "x.c"): ("x.c", False), (1, ".\\./y.c"): ("a/y.c", False), (1, "y.c"): ("a/y.c", False), (1, "/R/a\\y.c"): ("a/y.c", False), (1, "z.c"): ("a/b/z.c", False), (2, "x.c"): ("a/x.c", False), (2, "no.c"): (None, False), (2, None): (None, False)}
    more = joins.scope_paths(spark.createDataFrame([(1, "x.c")], "scope long, path string"), files.where("path != 'x.c'"), tops, []).first()
    assert (more.resolved, more.ambiguous) == (None, True)


def test_top_scored(spark):
    rows = spark.createDataFrame([(1, None, " high "), (2, 7.0, None), (3, None, "?"), (4, 9.5, "low"), (5, None, None)], "ord long, score double, severity string")
    assert [(r.ord, r.place) for r in ranking.top_scored(rows, 3).orderBy("place").collect()] == [(4, 1), (1, 2), (2, 3)]
    assert ranking.top_scored(rows, 99).count() == 5
    for none in (None, 0, -1):
        assert [r.ord for r in ranking.top_scored(rows, none).orderBy("place").collect()] == [1, 2, 3, 4, 5]


def test_policy_gate(spark):
    rows = spark.createDataFrame([("CWE-1", "x"), ("CWE-2", "x"), ("CWE-3", "a\\ci\\x"), ("CWE-3", None), ("CWE-4", "x"), (None, "x")], "cwe string, path string")
    deny = [("CWE-1", "one", ["CWE-2"]), ("CWE-2", "two", ["CWE-1"])]
    got = [(r.action, r.reason, r.matched) for r in filters.policy_gate(rows, deny, ["**/ci/*"], ["CWE-3"]).collect()]
    assert got == [("guidance_only", "one", "deny:CWE-1"), ("guidance_only", "two", "deny:CWE-2"), ("guidance_only", "sensitive_path:**/ci/*", "deny_path:**/ci/*"), ("patch", "allow_list", "allow:CWE-3"), ("guidance_only", "default_action", None), ("guidance_only", "unmapped_cwe", None)]
    assert {(r.action, r.reason) for r in filters.policy_gate(rows, deny, [], [], killed="env").collect()} == {("guidance_only", "kill_switch_env")}
    assert filters.policy_gate(rows, [], [], []).count() == 6
