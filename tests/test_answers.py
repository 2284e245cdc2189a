"""Parsers and rules against fixed cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sievemill.functions import answers, coerce, names, priority
from sievemill.operators import filters, windows


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('Here:\n```json\n{"a": "x ``` y"}\n```', {"a": "x ``` y"}),
        ('```\nprint()\n```\nthen [1, {"b": 2}]', [1, {"b": 2}]),
        ('{"a": "\\d+ C:\\Users"}', {"a": "\\d+ C:\\Users"}),
        ('a { stray and {"a": "}"} more', {"a": "}"}),
        ('{"a": [10]', [10]),
        ("none", None),
        ("", None),
        ("{[}]", None),
        (None, None),
    ],
)
def test_json_of(text, want):
    got = answers.json_of(text)
    assert (None if got is None else json.loads(got)) == want


def test_verdicts(spark):
    v = "CVSS:3.1/AV:{}/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    cases = [
        ("why\nVERDICT: TRUE_POSITIVE (confidence: 9/10) - reachable\n" + v.format("N"), ("TRUE_POSITIVE", 9, "reachable", v.format("N"), "why")),
        (v.format("L") + "\nverdict: false_positive (confidence: 12/10)", ("FALSE_POSITIVE", 10, "(no reason given)", v.format("L"), v.format("L"))),
        ("nothing", ("FALSE_POSITIVE", 0, "verifier output unparseable", None, "nothing")),
        (None, ("FALSE_POSITIVE", 0, "verifier output unparseable", None, "")),
    ]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "ord int, text string")
    got = {r["ord"]: (r["verdict"], r["confidence"], r["reason"], r["vector"], r["reasoning"]) for r in answers.verdicts(table).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_confidence(spark):
    cases = {"95%": 0.95, "7": 0.7, "7%": 0.7, "1%": 1.0, "2.5": 0.025, "1.2": 1.0, "NaN": 0.5, "-3": 0.0, "high": 0.5, "0.4": 0.4, "100": 1.0, "150": 1.0}
    got = spark.createDataFrame([(k,) for k in [*cases, None]], "raw string").select("raw", coerce.confidence(F.col("raw")).alias("c")).collect()
    assert {r["raw"]: r["c"] for r in got} == cases | {None: 0.5}


def test_priority(spark):
    base = "CVSS:3.1/AV:N/AC:{}/PR:{}/UI:N/S:U/C:H/I:H/A:H"
    rows = [
        ("Upload", "injection", "", base.format("L", "N"), True, "P1"),
        ("Upload", "injection", "unauthenticated", base.format("H", "L"), True, "P2"),
        ("Hardcoded password", "auth", "", base.format("L", "N"), True, "P4"),
        ("Upload", "injection", "", base.format("L", "N"), False, "P3"),
        ("Upload", "injection", "", base.format("L", "N"), None, "P3"),
        ("Upload", "injection", "requires admin", base.format("L", "N"), True, "P3"),
    ]
    table = spark.createDataFrame(rows, "t string, c string, d string, v string, e boolean, want string")
    tier, reason = priority.tier(*[F.col(x) for x in "tcdve"])
    got = table.select("want", tier.alias("got"), reason.alias("reason")).collect()
    assert all(r["want"] == r["got"] and r["reason"] for r in got)
    assert [r["reason"] for r in got][1].endswith("AC:H - complex preconditions")


def test_empty_inventory_opens_its_gate(spark):
    findings = spark.createDataFrame([("a.c", "heap-overflow", 0.9)], "file string, vuln_class string, confidence double")
    none = spark.createDataFrame([], "file string")
    assert filters.gate_cascade(findings, none).collect()[0]["reason"] is None
    assert filters.gate_cascade(findings, none.union(spark.createDataFrame([("b.c",)], "file string"))).collect()[0]["reason"] == "not in inventory"


def test_windows_stay_in_the_file(spark):
    anchors = spark.createDataFrame([("a", 5, 40), ("a", 38, 40)], "file string, line int, lines int")
    assert [tuple(r) for r in windows.merge_intervals(anchors, 10, 3).orderBy("lo").collect()] == [("a", 0, 15), ("a", 28, 40)]


def test_shortened(spark):
    text = "  " + "a" * 1000 + "b" * 1000 + "\n"
    got = spark.createDataFrame([(text,), ("x" * 1800,)], "t string").select(names.shorten_middle(F.col("t"))).collect()
    assert got[0][0] == "a" * 900 + "\n...<truncated>...\n" + "b" * 700 and got[1][0] == "x" * 1800


def test_many_brackets_take_linear_time():
    """Five million characters of brackets that never close; those before a value don't hide it."""
    for part in ("{ ", "[{", '{"', "{[\"x\", "):
        text = part * (4_000_000 // len(part))
        start = time.perf_counter()
        assert answers.json_of(text) is None
        assert answers.json_of(text[:200_000] + '\n"] {"a": [1]}') in ('{"a": [1]}', "[1]", None)
        assert time.perf_counter() - start < 60
    assert answers.json_of('{ { {"a": 1}') == '{"a": 1}' and answers.json_of('"{" [2]') == "[2]"


def test_texts_are_searched_once_for_their_tier(spark):
    """Each list of words was searched as one pattern wherever priority and reason name it, and the text was lower-cased there again."""
    rows = [(1, "Unauthenticated upload", "", "", "CVSS:3.1/AV:N/PR:N", True), (2, "on the VPN", "auth", "", "", True), (3, "x", "Hardcoded-Secret", "", "", None), (4, "x", None, None, None, None), (5, "[AllowAnonymous] 127.0.0.1", "", "an admin user", "AV:N/PR:H/AC:H", False)]
    df = spark.createDataFrame(rows, "k long, t string, c string, d string, v string, e boolean")
    out = priority.tiered(df, "k", list("tcdve"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("loopback") == 1 and plan.count("lower(concat_ws") == 1
    both = priority.tier(*[F.col(x) for x in "tcdve"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.select("k", *both).collect()))
