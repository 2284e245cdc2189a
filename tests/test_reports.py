"""Reports that are written, read back and marked; texts of other hands."""

from pyspark.sql import functions as F

from sievemill.operators import reports

FINDING = (
    "scope long, place long, severity string, title string, kind string, cwe string, file string, line_start long, line_end long, cvss_score double, cvss_rating string, cvss_vector string, context_score double, context_rating string, context_vector string, priority string, reason string, confidence double, votes long,"
    " duplicates array<struct<file: string, line_start: long, line_end: long>>, description string, impact string, scenario string, preconditions array<string>, snippet string, fix string, notes string, verdict string, verdict_confidence long, verdict_reason string, reasoning string, run_status string, run_evidence string, run_command string, detail string"
)
FULL = (1, 1, "high", "SQL in\nquery", "injection", None, "a/b.c", 3, 9, 9.8, "Critical", "V", 8.8, "High", "E", "P1", "open", 0.85, 1, [("c.c", 1, 0)], "# Big\ntext", "bad", "", ["x|y"], "code()", "do\n#### so", "easy", "TRUE_POSITIVE", 9, "seen", "long", "crash", "log", "./x", "No run.")
BARE = (1, 2, "low", "t", "other", None, "z.c", 1, 1, *[None] * 3, *[None] * 3, None, None, 0.5, 2, [], *[None] * 2, None, None, None, None, None, *[None] * 4, None, None, None, None)
HEAD = "scope long, name string, summary string, raw long, before string, after string, degraded boolean"
CHAIN = "scope long, place long, severity string, title string, steps array<int>, blocked array<string>, narrative string"


def made(spark, heads, findings, chains=(), dropped=()):
    args = (spark.createDataFrame(list(x), k) for x, k in ((heads, HEAD), (findings, FINDING), (chains, CHAIN), (dropped, "scope long, reason string")))
    return reports.written(*args)


def test_written_and_read_back(spark):
    df = made(spark, [(1, "r<e>po", "all", 8, None, None, False), (2, None, None, 0, None, "end\n", True)], [FULL, BARE], [(1, 1, "high", "C", [0, 1], ["waf"], "so")], [(1, "DUPLICATE"), (1, "FALSE_POSITIVE"), (1, "GUARDRAIL_BLOCKED")])
    text = {r.scope: r.text for r in df.collect()}
    assert text[1].startswith("# Static analysis — repo\n\n## Summary\nall\n\n## Verification\n- Raw findings (pre-verification): 8\n- True positives (verified): 2\n- False positives (dropped): 1\n- Verifier errors (excluded — undetermined, not confirmed clean): 1\n- Duplicates collapsed (all passes): 1\n- Verification precision: 25.0%\n\n## Findings (2)\n\n### 1. [HIGH] SQL in query\n")
    assert text[1].endswith("## Exploit Chains\n\n### [HIGH] C\n**Path:** #1 SQL in query → #2 t  \n**Blocked by:** waf\n\nso\n")
    assert text[2] == "# Static analysis — \n\n## Summary\n\n\n## Verification\n- Raw findings (pre-verification): 0\n- True positives (verified): 0\n- False positives (dropped): 0\n- Verifier errors (excluded — undetermined, not confirmed clean): 0\n- Duplicates collapsed (all passes): 0\n- Verification precision: 0.0%\n\n## Findings (0)\n\nend"
    first, second = reports.parsed(df).orderBy("scope", "place").collect()
    assert (first["index"], first.severity, first.title, first.done, first.ref, first.file, first.line_start, first.line_end) == (1, "HIGH", "SQL in query", False, "a/b.c:3-9", "a/b.c", 3, 9)
    assert (first["class"], first.cwe, first.cvss_score, first.cvss_rating, first.cvss_vector, first.confidence, first.votes) == ("CWE-74: Improper Neutralization of Special Elements in Output (Injection)", "CWE-74", "9.8", "Critical", "V", "0.85", "1")
    assert (first.verdict, first.verdict_confidence, first.verdict_reason, first.snippet) == ("TRUE_POSITIVE", "9", "seen", "code()")
    assert first.sections["description"] == "**Big**\ntext" and first.sections["impact"] == "bad" and first.sections["how to fix"].startswith("do\n**so**") and "exploit scenario" not in first.sections
    assert first.sections["preconditions"].startswith("- x\\|y") and first.sections["asan runtime evidence"] == "**Status:** crash\n\n**Trigger command:**\n\n```bash\n./x\n```\n\nlog"
    assert (second["index"], second["class"], second.cwe, second.cvss_vector, second.verdict) == (2, "other", None, None, None)


def test_unconfirmed(spark):
    heads = spark.createDataFrame([(1, "r"), (2, "s")], "scope long, name string")
    text = {r.scope: r.text for r in reports.unconfirmed(heads, spark.createDataFrame([FULL, BARE], FINDING)).collect()}
    assert "\n- ASAN-unconfirmed candidates: 2\n" in text[1] and "### 1. [HIGH] SQL" in text[1] and "### 2. [INFO] t" in text[1] and reports.CANDIDATE + "No run.\n" in text[1] and "Verdict" not in text[1]
    assert text[2].endswith("## Findings (0)\n\n_None._")


def test_marks_twice_are_marks_once(spark):
    text = "# T\n### 1. [high] One  \nx\n### 2. [LOW] Two <!-- remediation-agent:done -->\n### 3. [LOW] Three"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "scope long, text string")
    done = spark.createDataFrame([(1, 1, "HIGH"), (1, 2, "low"), (1, 3, "HIGH"), (1, 1, "high")], "scope long, index long, severity string")
    once = reports.marked_done(df, done)
    got = {r.scope: r.text for r in once.collect()}
    assert got == {1: text.replace("One  ", f"One  {reports.DONE}"), 2: None, 3: ""}
    assert {r.scope: r.text for r in reports.marked_done(once, done).collect()} == got
    assert [(r["index"], r.title, r.done) for r in reports.parsed(once).orderBy("place").collect()] == [(1, "One", True), (2, "Two", True), (3, "Three", False)]


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no finding\n### 1. [BAD] x"), (4, "### 7. [LOW] a\r\n**File:** ` `\n#### A\n#### A\ny")], "scope long, text string")
    (row,) = reports.parsed(df).collect()
    assert (row.scope, row["index"], row.file, row.line_start, row.sections["a"], row.snippet) == (4, 7, None, 0, "y", "")
    assert reports.parsed(df.where(F.lit(False))).collect() == []


def test_fields_are_searched_once(spark):
    """A field's line is looked for once in a finding that has its mark; a reason may be empty, other fields are null then."""
    text = "### 1. [LOW] a\n**Verdict:** FALSE (confidence: 3/10) \n**Confidence:** x\n### 2. [LOW] b\n**Confidence:** 0.5 (1 run agreed)\n### 3. [LOW] c\n **CWE:** CWE-1"
    out = reports.parsed(spark.createDataFrame([(1, text)], "scope long, text string"))
    got = [(r.verdict, r.verdict_confidence, r.verdict_reason, r.confidence, r.votes, r.cwe) for r in out.orderBy("place").collect()]
    assert got == [("FALSE", "3", "", None, None, None), (None, None, None, "0.5", "1", None), (None,) * 6]
    plan = out.select("scope", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\*\*Confidence:\*\*") == 1


def test_parts_are_read_as_their_whole(spark):
    lines = ["# T", "x", "### 1. [LOW] a", "**File:** `f.c:1`", "#### Impact", "bad", "### 2. [HIGH] b", "#### Impact", "", "worse", "### 3. [LOW] c", "end"]
    want = reports.parsed(spark.createDataFrame([(1, "\n".join(lines))], "scope long, text string")).drop("place").orderBy("index").collect()
    for size in (1, 3, 5):
        parts = spark.createDataFrame([(1, i, "\n".join(lines[i : i + size]) + "\n") for i in range(0, len(lines), size)], "scope long, place long, part string")
        for near in (2, 100):
            assert reports.parsed_parts(parts, near).drop("place").orderBy("index").collect() == want
