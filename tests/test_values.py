"""Weakness rules, spellings, folder names, cards, nested masks and whole report documents."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from sievemill.functions import cards, coerce, weakness
from sievemill.operators import clusters, ranking, sarif, trees


def test_first_rule_wins(spark):
    said = ["IDOR on card id", "mass assignment", "disable certificate validation", "hardcoded api key", "magic link", "debug mode", "SSRF by sql injection", "not bound to the authenticated user", "log\nof otp", "", "no auth; magic link"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, t string")
    got = [r.w for r in df.select("i", weakness.derived(F.col("t"), F.lit(None), F.lit("")).alias("w")).orderBy("i").collect()]
    assert got == [next((c for words, c in weakness.OF_WORDS if re.search(words, t, re.I)), None) for t in said]
    assert got[:7] == ["CWE-639", "CWE-915", "CWE-295", "CWE-798", "CWE-640", "CWE-489", "CWE-89"]
    own = df.select(weakness.derived(F.col("t"), F.lit("injection"), F.lit(None), [("magic", "CWE-1")]).alias("w")).collect()
    assert [r.w for r in own][3:6] == ["CWE-74", "CWE-1", "CWE-74"]


def test_spellings(spark):
    df = spark.createDataFrame([("a_b",), (" A-b ",), ("A B",), ("Exact",), ("exact",), ("short",), ("",), (None,)], "v string")
    got = [r.m for r in df.select(coerce.enum(F.col("v"), ["a_b", "Exact"], {"short": "a_b"}, "d").alias("m")).collect()]
    assert got == ["a_b", "a_b", "a_b", "Exact", "d", "a_b", "d", "d"]


def test_folder_names_that_look_like_hashes(spark):
    rnd = random.Random(3)
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()[:8]
    names = ["o/svc", "p/svc", "q/svc.git", "o/svc/", "svc-" + digest("p/svc"), f"z/svc-{digest('q/svc.git')}", "x/other", ""]
    rows = [(a, i, rnd.choice(names)) for a in range(12) for i in range(9)] + [(99, 1, "o/svc"), (99, 2, "svc-" + digest("p/svc")), (99, 3, "p/svc")]
    want = {}
    for a in {r[0] for r in rows}:
        used = set()
        for _, i, name in sorted(r for r in rows if r[0] == a):
            base = re.sub(r"(?i)\.git$", "", name.rstrip("/").rsplit("/", 1)[-1]) or "repo"
            slug, salt = base, name
            while slug in used:
                slug = f"{base}-{digest(salt)}"
                salt = slug + name
            used.add(slug)
            want[a, i] = slug
    got = clusters.folder_names(spark.createDataFrame(rows, "app long, ord long, name string"))
    assert got.columns == ["app", "ord", "name", "slug"]
    assert {(r.app, r.ord): r.slug for r in got.collect()} == want


def test_earlier_places_go_to_the_root(spark):
    f = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 3, 4), (3, "b", 1, 2), (4, "c", 1, 1)], "ord long, file string, line_start int, line_end int")
    links = spark.createDataFrame([(2, 1), (3, 2)], "dup long, canonical long")
    had = spark.createDataFrame([(1, 0, "b", 1, 2), (2, 0, "x", 9, 9), (3, 0, "x", 9, 9), (3, 1, "a", 1, 5), (4, 0, "k", 1, 1), (4, 1, "k", 1, 1)], "ord long, place int, file string, line_start int, line_end int")
    got = sorted(map(tuple, ranking.attach(f, links, had).collect()))
    # the root's own earlier place stands for that of the third finding; a finding without links keeps its repeats
    assert got == [(1, 1, "b", 1, 2), (1, 2, "x", 9, 9), (1, 3, "a", 1, 5), (4, 4, "k", 1, 1), (4, 4, "k", 1, 1)]
    assert sorted(map(tuple, ranking.attach(f, links).collect())) == [(1, 3, "b", 1, 2)]


def test_cards_look_back(spark):
    no, odd = "4111 1111 1111 1112", "12345678901234567890"
    texts = [f"card{'.' * k}{no}" for k in (43, 44, 45)] + [f"xcard{'.' * 44}{no}", f"card {no} {no} {no} {no} {no}", f"{odd} card", "4111111111111111", None, "", f"card\n{no}\ttail"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.m for r in df.select("i", cards.masked(F.col("t")).alias("m")).orderBy("i").collect()]
    hid = "4111 XXXX XXXX XXXX"
    assert got[:4] == [texts[0].replace(no, hid), texts[1].replace(no, hid), texts[2], texts[3].replace(no, hid)]
    # each number sees the word only while it is within 48 characters of the text as it was
    assert got[4] == f"card {hid} {hid} {hid} {no} {no}" and got[5:] == [f"{odd} card", "4111XXXXXXXXXXXX", None, "", f"card\n{hid}\ttail"]


def test_trees_keep_their_schema(spark):
    kind = "id long, s string, n struct<a: string, b: array<array<string>>, c: map<string, struct<t: string, k: int>>>, plain array<int>"
    secret, gone = "password=correcthorse", "password=[REDACTED-SECRET]"
    rows = [(1, secret, (secret, [[secret, None], [], None], {secret: (secret, 1), "x": None}), [1]), (2, None, None, None), (3, "ok", ("ok", [], {}), [])]
    df = spark.createDataFrame(rows, kind)
    out = trees.masked(df, "id", ["s", "n"])
    got = {r.id: r for r in out.collect()}
    assert got[1].s == gone and got[1].n.a == gone and got[1].n.b == [[gone, None], [], None]
    assert got[1].n.c[secret].t == gone and got[1].n.c[secret].k == 1 and got[1].n.c["x"] is None and got[1].plain == [1]
    assert tuple(got[2]) == (2, None, None, None) and got[3].s == "ok" and got[3].n.b == []
    assert out.schema.simpleString() == df.schema.simpleString()


FINDINGS = "scope long, ord long, title string, severity string, category string, cwe string, cvss string, cvss_score double, description string, file string, line long, context_vector string, context_score double, context_rating string, priority string, reason string, confidence double, votes long"


def test_sarif(spark):
    none = [None] * 3
    rows = [
        (1, 1, 'Say "hi"\n', "HIGH", "injection", "cwe-89", "V", 9.84, "d" * 4001, "a.c", 3, "E", 8.8, "High", "P1", None, 0.555, 2),
        (1, 2, "password=correcthorse", "INFO", "", None, None, None, "", None, None, *none, None, None, None, None),
        (1, 3, "t", "LOW", "injection", None, None, -1.0, None, "b.c", 1, *none, "", None, 1.0, 0),
        (2, 4, "t", "MEDIUM", "other", "CWE-9999", "V", 0.0, "x", "", 1, None, -1.0, None, "P4", "r", -1.0, 3),
    ]
    places = [(1, 1, "p2", 5, 0), (1, 0, "p1", 4, 9)]
    apps = [(1, "A1", "application", "App")]
    health = [(1, [("z", 2), ("a", 1)], 3, True, False), (2, None, 0, None, None)]
    args = spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(places, "ord long, place long, file string, line_start long, line_end long"), spark.createDataFrame(apps, "scope long, id string, source string, name string")
    docs = {r.scope: json.loads(r.sarif) for r in sarif.documents(*args, "g", "1.2", spark.createDataFrame(health, "scope long, errors array<struct<stage: string, n: long>>, chunks_failed long, degraded boolean, successful boolean")).collect()}
    run = docs[1]["runs"][0]
    assert (docs[1]["$schema"], docs[1]["version"]) == (sarif.SCHEMA, "2.1.0")
    driver = run["tool"]["driver"]
    assert driver["version"] == "1.2" and driver["supportedTaxonomies"] == [{"guid": "g"}]
    # the first finding of a rule that has a name gives it
    assert driver["rules"] == [{"id": "injection", "name": "injection", "shortDescription": {"text": weakness.NAMES["CWE-89"]}}, {"id": "info", "name": "info"}]
    assert [t["id"] for t in run["taxonomies"][0]["taxa"]] == ["CWE-74", "CWE-89"]
    assert run["properties"] == {"applicationId": "A1", "cmdbSource": "application", "applicationName": "App", "scanDegraded": True, "unrankedFallback": True}
    first, second, third = run["results"]
    assert first["message"]["text"] == 'Say "hi"\n  [CVSS 9.8: V]' and first["level"] == "error" and first["rank"] == 98.4
    assert first["properties"] == {
        "severity": "high", "security-severity": "9.8", "cvssRating": "Critical", "category": "injection", "cvssVector": "V", "cwe": "CWE-89 - " + weakness.NAMES["CWE-89"], "cweId": "CWE-89", "cweName": weakness.NAMES["CWE-89"], "cvssScore": 9.8,
        "vulContextSeverityVector": "E", "vulContextSeverityScore": 8.8, "vulContextSeverityRating": "High", "offensivePriority": "P1", "offensivePriorityLabel": "Externally Exploitable, No Auth", "offensivePriorityReason": None,
        "confidence": 0.56, "votes": 2, "description": "d" * 4000 + "…", "dedupRelatedLocationCount": 2,
    }
    assert [(x["physicalLocation"]["artifactLocation"]["uri"], x["physicalLocation"]["region"]) for x in first["relatedLocations"]] == [("p1", {"startLine": 4, "endLine": 9}), ("p2", {"startLine": 5})]
    assert second["message"]["text"] == "password=[REDACTED-SECRET]" and second["ruleId"] == "info" and "taxa" not in second and "rank" not in second
    assert second["properties"] == {"severity": "info", "security-severity": "0.0", "cvssRating": "None", "category": "", "cvssVector": None, "description": ""}
    assert second["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "unknown"}, "region": {"startLine": None}}
    assert third["taxa"][0]["id"] == "CWE-74" and third["properties"]["confidence"] == 1.0 and "votes" not in third["properties"]
    assert run["invocations"] == [{"executionSuccessful": False, "toolExecutionNotifications": [{"level": "warning", "message": {"text": t}} for t in (
        "a: 1 recoverable error(s) logged", "z: 2 recoverable error(s) logged", "3 deep-dive chunk(s) failed or timed out; their findings are absent", "Exploit-chain analysis could not be computed; findings are unranked")]}]
    other = docs[2]["runs"][0]
    assert other["properties"] == {"applicationId": None, "scanDegraded": False, "unrankedFallback": False} and other["invocations"] == [{"executionSuccessful": True}]
    assert other["results"][0]["rank"] == 0.0 and other["taxonomies"][0]["taxa"] == [{"id": "CWE-9999", "helpUri": "https://cwe.mitre.org/data/definitions/9999.html"}]
    plain = {r.scope: json.loads(r.sarif) for r in sarif.documents(*args, "g", "1.2", mask=False).collect()}
    assert "invocations" not in plain[1]["runs"][0] and plain[1]["runs"][0]["results"][1]["message"]["text"] == "password=correcthorse"


def test_strings_are_masked_once_they_are_one(spark):
    """No detector stands below the grouping of equal strings, where it would see each row's."""
    df = spark.createDataFrame([(1, "password=correcthorse"), (2, "password=correcthorse")], "id long, s string")
    out = trees.masked(df, "id", ["s"])
    assert [r.s for r in out.orderBy("id").collect()] == ["password=[REDACTED-SECRET]"] * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Aggregate [_leaf")
    assert "client[_-]?secret" in plan[:at] and "client[_-]?secret" not in plan[at:]
