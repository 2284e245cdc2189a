"""Diffs that give back the second text; notes in reports, and that doing it again changes nothing."""

import random

from pyspark.sql import functions as F

from sievemill.functions import diffs
from sievemill.operators import notes, patches
from sievemill.sources import files as readers

FILES = "scope long, ord long, path string, before string, after string"


def versions():
    rnd = random.Random(8)
    words = ["a", "b", "b", "é", "x\r", "", " ", "+", "-", "@@ -1 +1 @@", "\\ No newline at end of file", "diff --git a/x b/x", "\u2028"]
    out = []
    for i in range(300):
        a = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        b = [x for x in a if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.choice(words))
        ends = [rnd.choice(["", "\n"]) for _ in range(2)]
        out.append((i % 3, i, f"f{i}.c", None if i % 20 == 0 else "\n".join(a) + ends[0], "" if i % 20 == 1 else "\n".join(b) + ends[1]))
    out += [(7, 1, "long.c", "same\n" * 5000, "same\n" * 2500 + "new\n" + "same\n" * 2500), (7, 2, "null.c", None, None), (7, 3, "gone.c", "x", None)]
    return out


def test_exact_diffs_give_back_the_second_text(spark):
    rows = versions()
    df = spark.createDataFrame(rows, FILES).withColumn("diff", diffs.diff(F.col("before"), F.col("after"), F.col("path"), True))
    got = {r.path: r for r in df.withColumn("made", diffs.applied(F.col("before"), F.col("diff"))).collect()}
    for _, _, path, before, after in rows:
        if (before or "") == (after or ""):
            assert got[path]["diff"] is None and got[path].made == before
        else:
            assert got[path].made == (after or "")
    assert diffs._applied("other\n", got["gone.c"]["diff"]) is None


def test_form(spark):
    rows = [(1, 1, "./d/../a.c", "1\n2\n3\n4\n5\n6\n7\n8\n9", "1\n2\n3\n4\nfive\n6\n7\n8\n9"), (1, 2, "new.c", None, "x\n"), (1, 3, "../out.c", "a", "b"), (1, 4, "a.c", "a", "b"), (1, 5, "/etc/x", "a", "b"), (1, 6, "same.c", "a", "a"), (2, 1, "gone.c", "x\ny\n", ""), (3, 1, None, "a", "b")]
    made = patches.patches(patches.file_diffs(spark.createDataFrame(rows, FILES)))
    got = {r.scope: r.patch for r in made.collect()}
    assert got == {
        1: diffs.HEADER + "diff --git a/a.c b/a.c\n--- a/a.c\n+++ b/a.c\n@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\ndiff --git a/new.c b/new.c\n--- /dev/null\n+++ b/new.c\n@@ -0,0 +1 @@\n+x\n",
        2: diffs.HEADER + "diff --git a/gone.c b/gone.c\n--- a/gone.c\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y\n",
    }
    assert sorted((r.scope, r.path) for r in readers.changed_paths(made, "scope", "patch").collect()) == [(1, "a.c"), (1, "new.c"), (2, "gone.c")]
    n = spark.createDataFrame([(got[1].split("\n", 1)[1].split("diff --git a/new")[0],)], "d string").select(diffs.changed_lines(F.col("d")).alias("n")).first().n
    assert (n.added, n.removed, n.hunks) == (1, 1, 1)


V = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
ENV = V + "/E:P/RL:O/RC:C/CR:H/IR:H/AR:M/MAV:N"
REPORT = f"""# R
### 1. [HIGH] One
**CVSS:** `{V}`


VulContextSeverity: 1.0 (Low) - old
tail
### 2. [LOW] Two
CVSS 3.1 base {V} here
### 3. [LOW] Three
**Base Vector:** `AV:N` - **5.0**
## Appendix
**CVSS:** `{V}`"""
NOTED = f"""# R
### 1. [HIGH] One
**CVSS:** `{V}` - **9.8**

**VulContextSeverity:** `{ENV}` - **8.8 (High)**

**OffensivePriority:** **P1** - Externally Exploitable, No Auth | *open*
tail
### 2. [LOW] Two
CVSS 3.1 base {V} here

VulContextSeverity: 8.8 (High) - {ENV}

OffensivePriority: P3 - Internal Network / Privileged Position (None)
### 3. [LOW] Three
**Base Vector:** `AV:N` - **5.0**
## Appendix
**CVSS:** `{V}`
"""


def test_notes_twice_are_notes_once(spark):
    apps = spark.createDataFrame([(1, True, True, False, False), (3, False, False, False, False)], "scope long, external boolean, pci boolean, pan boolean, pii boolean")
    found = spark.createDataFrame([(1, 0, "P1", "open"), (1, 1, "P3", None), (1, 2, None, "x"), (2, 0, "P2", "r")], "scope long, place int, priority string, reason string")
    reports = spark.createDataFrame([(1, REPORT), (2, "no vector\n\n"), (3, None), (4, "")], "scope long, text string")

    def noted(df):
        return notes.priority_notes(notes.score_notes(df, apps).select("scope", "text"), found)

    once = {r.scope: (r.text, r.changed) for r in noted(reports).collect()}
    assert once == {1: (NOTED, True), 2: ("no vector\n\n", False), 3: (None, False), 4: ("", False)}
    scores = notes.score_notes(spark.createDataFrame([(1, NOTED)], "scope long, text string"), apps).first()
    # the next line that is not blank is the context line itself, which is the same
    assert (scores.text, scores.changed) == (NOTED, False)
    assert [(r.text, r.changed) for r in noted(spark.createDataFrame([(1, NOTED)], "scope long, text string")).collect()] == [(NOTED, False)]
    # without an application only scores are added
    bare = notes.score_notes(spark.createDataFrame([(9, REPORT)], "scope long, text string"), apps).first()
    assert bare.text == REPORT.replace(f"`{V}`\n\n\nVul", f"`{V}` - **9.8**\n\n\nVul") + "\n"


def test_fix_sections(spark):
    reports = spark.createDataFrame([(1, "intro\n### 1. [HIGH]  SQL <b>  \nbody\n\n### Remediation\nold\n### 2. [LOW] Other\n## Remediation Summary\nold\n"), (2, "no heading\n"), (3, None)], "scope long, text string")
    fixes = spark.createDataFrame([(1, 5, "sql <B>", "remediated", "why", "did\r\nit #1", ["x`y.c", "", "x`y.c"], False), (1, 6, "else", "deny", None, None, None, True), (2, 1, "z", "deny", None, None, None, None)], "scope long, id long, title string, state string, reason string, summary string, files array<string>, rejected boolean")
    out = {r.scope: r.text for r in notes.fix_sections(reports, fixes).collect()}
    assert out[2] == "no heading\n" and out[3] is None
    assert out[1] == (
        "intro\n### 1. [HIGH]  SQL <b>  \nbody\n\n### Remediation\n- **Status:** remediated\n- **Summary:** did it \\#1\n- **Approach:** " + notes.APPROACH["remediated"] + "\n- **Details of what was remediated:**\n  - `xy.c`\n\n"
        "### 2. [LOW] Other\n\n### Remediation\n- **Status:** skipped\n- **Summary:** finding not processed for remediation\n- **Approach:** " + notes.NO_APPROACH + "\n- **Details of what was remediated:**\n  - (no files changed)\n\n"
        "\n## Remediation Summary\n- Total findings (true positive): 1\n- Findings in scope for remediation: 2\n- Remediated: 1\n- Success Rate(remediated/true positive): 50%\n"
    )
    again = notes.fix_sections(spark.createDataFrame([(1, out[1])], "scope long, text string"), fixes).first().text
    assert again == out[1]


def test_paths_of_a_patch_in_parts(spark):
    one, two = "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n-a\n+b\n", "diff --git a/y.c b/y.c\n--- /dev/null\n+++ b/y.c\n@@ -0,0 +1 @@\n+b\n"
    parts = spark.createDataFrame([(1, 5, two), (1, 3, one), (1, 9, one), (2, 1, None)], "scope long, ord long, diff string")
    got = readers.changed_paths(parts, "scope", part="ord").orderBy("place").collect()
    assert [(r["scope"], r["path"], tuple(r["place"])) for r in got] == [(1, "x.c", (3, 0)), (1, "y.c", (5, 0))]


def test_no_row_holds_a_patch_and_versions_are_read_once(spark):
    from sievemill.plans import documents

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan(documents.patch_paths(spark, "/root/testdata/sf0.001"))
    assert plan(documents.diff_synth(spark, "/root/testdata/sf0.001")).count("Relation") == 1


def test_reports_are_noted_once(spark):
    """A step names its reports twice; without a table between, two steps made and scored them four times and twice."""
    from sievemill.plans import documents

    plan = documents.report_notes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and "/CR:" not in plan and "## Appendix" not in plan


def test_fixes_are_put_into_reports_in_parts(spark):
    """The text of each report was put together twice, joined with its fixes twice and put together again."""
    from sievemill.plans import documents

    plan = documents.fix_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "## Appendix" not in plan and "collect_list" not in plan
    reports = spark.createDataFrame([(1, "### 1. [HIGH] a\nb\n"), (2, "none"), (3, "")], "scope long, text string")
    fixes = spark.createDataFrame([], "scope long, id long, title string, state string, reason string, summary string, files array<string>, rejected boolean")
    parts = [(r.scope, r.place) for r in notes.fix_section_parts(reports, fixes).orderBy("scope", "step", "place").collect()]
    assert parts == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert {r.scope: r.text for r in notes.fix_sections(reports, fixes).where("scope != 1").collect()} == {2: "none", 3: ""}
