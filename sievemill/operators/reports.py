"""Reports of findings as Markdown, written for each repository and read back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import markdown, weakness
from sievemill.operators.notes import PRIORITIES

# Wordings of a report, and how its lines are told apart.
NO_CHAINS = "No exploit chains were identified — the findings above are independent and do not combine into a multi-step path."
UNCONFIRMED = "These candidates passed provisional adversarial static review, but ASAN did not produce runtime confirmation within the configured build/reproduction budget. They are not true positives unless a sanitizer crash is reproduced."
CANDIDATE = "Static review identified a plausible vulnerability, but ASAN runtime confirmation was not obtained. This candidate is not a confirmed true positive. "
SAME_CAUSE = " additional call site(s) collapsed during dedup — same root cause; each location needs the same fix applied.*"
HEADER = r"(?mdiU)^###[^\S\n]+(\d+)\.[^\S\n]*\[(CRITICAL|HIGH|MEDIUM|LOW|INFO)\][^\S\n]*(.+?)[^\S\n]*(<!--\s*remediation-agent:done\s*-->)?[^\S\n]*$"
_HEADING = HEADER.replace("^", r"\A", 1)
DONE = "<!-- remediation-agent:done -->"
FIELDS = {
    "class": (r"(?mdU)^\*\*Class:\*\*[^\S\n]*(.+?)[^\S\n]*$", 1), "cwe": (r"(?mdU)^\*\*CWE:\*\*\s*(CWE-\d+)", 1), "confidence": (r"(?mdU)^\*\*Confidence:\*\*\s*([0-9.]+)\s*\((\d+)\s+runs?\s+agreed\)", 1), "votes": (r"(?mdU)^\*\*Confidence:\*\*\s*([0-9.]+)\s*\((\d+)\s+runs?\s+agreed\)", 2),
    "cvss_score": (r"(?mdU)^\*\*CVSS 3\.1:\*\*\s*\*\*([0-9.]+)\*\*\s*\(([^)]+)\)\s*—\s*`([^`]+)`", 1), "cvss_rating": (r"(?mdU)^\*\*CVSS 3\.1:\*\*\s*\*\*([0-9.]+)\*\*\s*\(([^)]+)\)\s*—\s*`([^`]+)`", 2), "cvss_vector": (r"(?mdU)^\*\*CVSS 3\.1:\*\*\s*(?:\*\*[0-9.]+\*\*\s*\([^)]+\)\s*—\s*)?`([^`]+)`", 1),
    "verdict": (r"(?mdU)^\*\*Verdict:\*\*\s*(\w+)\s*\(confidence:\s*(\d+)/10\)[^\S\n]*—?[^\S\n]*(.*)$", 1), "verdict_confidence": (r"(?mdU)^\*\*Verdict:\*\*\s*(\w+)\s*\(confidence:\s*(\d+)/10\)[^\S\n]*—?[^\S\n]*(.*)$", 2), "verdict_reason": (r"(?mdU)^\*\*Verdict:\*\*\s*(\w+)\s*\(confidence:\s*(\d+)/10\)[^\S\n]*—?[^\S\n]*(.*)$", 3),
}


def _said(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _prose(name: str) -> Column:
    return markdown.demote_headings(_said(name))


def _section(title: str, name: str) -> Column:
    """A heading with a text and a blank line; null for a blank text."""
    return F.when(_said(name) != "", F.concat(F.lit(f"#### {title}\n"), _prose(name), F.lit("\n")))


def _blocks(f: DataFrame) -> DataFrame:
    """(scope, place, block): the text of each finding, without the line end after it."""
    cwe = weakness.stated(F.col("cwe"), F.col("kind"))
    f = f.withColumn("eff", cwe).withColumn("label", F.regexp_replace(weakness.label(F.col("eff")), "^(\\S+) - ", "$1: "))
    one = lambda c: F.format_string("%.1f", c)
    cvss = F.when(F.col("cvss_score").isNotNull(), F.concat(F.lit("**"), one("cvss_score"), F.lit("** ("), _said("cvss_rating"), F.lit(") — `"), _said("cvss_vector"), F.lit("`"))).when(_said("cvss_vector") != "", F.concat(F.lit("`"), "cvss_vector", F.lit("`"))).otherwise("_not computed_")
    priority = F.lit("")
    for k, v in PRIORITIES.items():
        priority = F.when(F.col("priority") == k, v).otherwise(priority)
    number = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    refs = F.transform("duplicates", lambda d: F.concat(F.lit("`"), d["file"], F.lit(":"), number(d["line_start"]), F.when((d["line_end"] != 0) & (d["line_end"] != d["line_start"]), F.concat(F.lit("-"), number(d["line_end"]))).otherwise(""), F.lit("`")))
    again, before = F.size("duplicates") > 0, F.size("preconditions") > 0
    return f.select("scope", "place", F.concat_ws(
        "\n",
        F.concat(F.lit("### "), number("place"), F.lit(". ["), F.upper("severity"), F.lit("] "), markdown.cell(F.col("title"))),
        F.concat(F.lit("**Class:** "), F.when(F.col("label") != "", F.col("label")).otherwise(F.col("kind"))),
        F.when(F.col("eff").isNotNull(), F.concat(F.lit("**CWE:** "), "label", F.lit(" - https://cwe.mitre.org/data/definitions/"), F.substring_index("eff", "-", -1), F.lit(".html"))),
        F.concat(F.lit("**File:** `"), "file", F.lit(":"), number("line_start"), F.lit("-"), number("line_end"), F.lit("`")),
        F.concat(F.lit("**CVSS 3.1:** "), cvss),
        F.when(F.col("context_score").isNotNull(), F.concat(F.lit("**VulContextSeverity:** `"), _said("context_vector"), F.lit("` - **"), one("context_score"), F.lit(" ("), _said("context_rating"), F.lit(")**"))),
        F.when(_said("priority") != "", F.concat(F.lit("**OffensivePriority:** **"), "priority", F.lit("** - "), priority, F.lit(" | *"), F.coalesce("reason", F.lit("None")), F.lit("*"))),
        F.concat(F.lit("**Confidence:** "), F.format_string("%.2f", F.bround("confidence", 2)), F.lit(" ("), number("votes"), F.when(F.col("votes") == 1, " run").otherwise(" runs"), F.lit(" agreed)")),
        F.when(again, F.concat(F.lit("**Also at:** "), F.array_join(refs, ", "))), F.lit(""), F.when(again, F.concat(F.lit("*"), number(F.size("duplicates")), F.lit(SAME_CAUSE), F.lit("\n"))),
        F.concat(F.lit("#### Description\n"), _prose("description"), F.lit("\n")), _section("Impact", "impact"), _section("Exploit scenario", "scenario"),
        F.when(before, F.concat(F.lit("#### Preconditions\n"), F.array_join(F.transform("preconditions", lambda p: F.concat(F.lit("- "), markdown.cell(p))), "\n"), F.lit("\n"))),
        F.concat(F.lit("```\n"), _said("snippet"), F.lit("\n```\n")), _section("How to fix", "fix"), F.concat(F.lit("**Exploitability:** "), _prose("notes"), F.lit("\n")),
        F.when(_said("verdict") != "", F.concat(F.lit("#### Adversarial verification\n**Verdict:** "), "verdict", F.lit(" (confidence: "), F.coalesce(number("verdict_confidence"), F.lit("None")), F.lit("/10) — "), _prose("verdict_reason"), F.lit("\n\n"), _prose("reasoning"), F.lit("\n"))),
        F.when((_said("run_status") != "") | (_said("run_evidence") != ""), F.concat(
            F.lit("#### ASAN runtime evidence\n**Status:** "), F.when(_said("run_status") != "", F.col("run_status")).otherwise("attempted"), F.lit("\n\n"),
            F.when(_said("run_command") != "", F.concat(F.lit("**Trigger command:**\n\n```bash\n"), "run_command", F.lit("\n```\n\n"))).otherwise(""), _prose("run_evidence"), F.lit("\n"))),
    ).alias("block"))


#: What reports call the tool that they are of; hand in your own.
TOOL = "Static analysis"


def _title(name: str, tool: str) -> Column:
    return F.concat(F.lit(f"# {tool} — "), F.regexp_replace(_said(name), r"[<>`|\[\]]", ""))


def _joined(blocks: DataFrame) -> DataFrame:
    """(scope, found, n): the blocks of each scope in order, a line end after each."""
    return blocks.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: F.concat(x["block"], F.lit("\n"))), "").alias("found"), F.count("*").alias("n"))


def _in_parts(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """(scope, step, place, part): what stands before the blocks of a scope, they, and what stands after them."""
    part = lambda step, c: frames.select("scope", F.lit(step).alias("step"), F.lit(0).cast("long").alias("place"), F.col(c).alias("part"))
    told = blocks.join(frames.select("scope").distinct(), "scope", "left_semi").select("scope", F.lit(1).alias("step"), F.col("place").cast("long").alias("place"), F.concat("block", F.lit("\n")).alias("part"))
    return part(0, "head").unionByName(told).unionByName(part(2, "tail"))


def _counted(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("scope").agg(F.count("*").alias("n"))


def written(reports: DataFrame, findings: DataFrame, chains: DataFrame, dropped: DataFrame, tool: str = TOOL) -> DataFrame:
    """(scope, text): the report of each row of ``reports`` (scope, name, summary, raw, before, after, degraded).

    ``findings`` (scope, place from 1, severity, title, kind, cwe, file, line_start, line_end, cvss_score, cvss_rating,
    cvss_vector, context_score, context_rating, context_vector, priority, reason, confidence, votes, duplicates,
    description, impact, scenario, preconditions, snippet, fix, notes, verdict, verdict_confidence, verdict_reason,
    reasoning, run_status, run_evidence, run_command); ``chains`` (scope, place, severity, title, steps: places of
    findings from 0, blocked, narrative); ``dropped`` (scope, reason).  ``before`` and ``after`` are sections that stand
    before the verification and at the end, with their own line ends.  Blank parts are left out, headings within texts
    become bold.  A degraded report without chains says nothing of them.  A text is held whole, so for reports that may
    not fit :func:`written_parts` gives what they are made of.
    """
    told = _joined(_blocks(findings))
    met = _framed(reports, told.select("scope", "n"), findings, chains, dropped, tool).join(told.drop("n"), "scope", "left")
    return met.select("scope", F.regexp_replace(F.concat("head", _said("found"), "tail"), r"\n\z", "").alias("text"))


def written_parts(reports: DataFrame, findings: DataFrame, chains: DataFrame, dropped: DataFrame, tool: str = TOOL) -> DataFrame:
    """(scope, step, place, part): the texts of :func:`written` in parts, which no row holds together.

    Joined by step and place they are the text, with one more line end at its end.  Scopes in ``reports`` are unique.
    """
    return _in_parts(_framed(reports, _counted(findings), findings, chains, dropped, tool), _blocks(findings))


def _framed(reports: DataFrame, counts: DataFrame, findings: DataFrame, chains: DataFrame, dropped: DataFrame, tool: str) -> DataFrame:
    """(scope, head, tail): what stands before and after the findings, of which ``counts`` (scope, n) tells how many there are."""
    why = lambda *r: F.count_if(F.col("reason").isin(*r))
    out = dropped.groupBy("scope").agg(why("FALSE_POSITIVE").alias("fp"), why("VERIFY_ERROR", "GUARDRAIL_BLOCKED").alias("errors"), why("DUPLICATE").alias("again"))
    step = chains.select("scope", "place", F.posexplode("steps").alias("i", "s")).withColumn("at", (F.col("s") + 1).cast("long"))
    step = step.join(findings.select("scope", F.col("place").cast("long").alias("at"), F.col("title").alias("_t")), ["scope", "at"])
    named = F.concat(F.lit("#"), F.col("at").cast("string"), F.lit(" "), markdown.cell(F.col("_t")))
    way = step.groupBy("scope", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", named.alias("t")))), lambda x: x["t"]), " → ").alias("way"))
    stopped = F.when(F.size("blocked") > 0, F.concat(F.lit("  \n**Blocked by:** "), F.array_join(F.transform("blocked", markdown.cell), ", "))).otherwise("")
    chain = F.concat(F.lit("### ["), F.upper("severity"), F.lit("] "), _said("title"), F.lit("\n**Path:** "), _said("way"), stopped, F.lit("\n\n"), _prose("narrative"), F.lit("\n\n"))
    linked = chains.join(way, ["scope", "place"], "left").select("scope", "place", chain.alias("c")).groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]), "").alias("chains"))
    met = reports.join(counts, "scope", "left").join(out, "scope", "left").join(linked, "scope", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    share = F.when(F.coalesce("raw", F.lit(0)) != 0, 100.0 * F.coalesce("n", F.lit(0)) / F.col("raw")).otherwise(0.0)
    # halves go to the even digit
    precision = F.format_string("%.1f", F.bround(share, 1))
    checked = F.concat(
        F.lit("## Verification\n- Raw findings (pre-verification): "), count("raw"), F.lit("\n- True positives (verified): "), count("n"), F.lit("\n- False positives (dropped): "), count("fp"), F.lit("\n- Verifier errors (excluded — undetermined, not confirmed clean): "), count("errors"),
        F.lit("\n- Duplicates collapsed (all passes): "), count("again"), F.lit("\n- Verification precision: "), precision, F.lit("%\n\n## Findings ("), count("n"), F.lit(")\n\n"),
    )
    tail = F.when(F.col("chains").isNotNull(), F.concat(F.lit("## Exploit Chains\n\n"), "chains")).when(~F.coalesce("degraded", F.lit(False)), F.lit(f"## Exploit Chains\n\n{NO_CHAINS}\n\n")).otherwise("")
    head = F.concat(_title("name", tool), F.lit("\n\n## Summary\n"), _prose("summary"), F.lit("\n\n"), _said("before"), checked)
    return met.select("scope", head.alias("head"), F.concat(tail, _said("after")).alias("tail"))


def unconfirmed(reports: DataFrame, candidates: DataFrame, tool: str = TOOL) -> DataFrame:
    """(scope, text): the report on findings that no run confirmed, for each row of ``reports`` (scope, name).

    ``candidates`` are findings as :func:`written` takes them, with ``detail`` instead of severity, notes and verdict: the
    severity is that of the context score, else the base score, and none is ``INFO``.
    """
    told = _joined(_blocks(_as_candidates(candidates)))
    met = _unconfirmed_framed(reports, told.select("scope", "n"), tool).join(told.drop("n"), "scope", "left")
    return met.select("scope", F.regexp_replace(F.concat("head", _said("found"), "tail"), r"\n\z", "").alias("text"))


def unconfirmed_parts(reports: DataFrame, candidates: DataFrame, tool: str = TOOL) -> DataFrame:
    """(scope, step, place, part): the texts of :func:`unconfirmed` as :func:`written_parts` gives those of reports."""
    return _in_parts(_unconfirmed_framed(reports, _counted(candidates), tool), _blocks(_as_candidates(candidates)))


def _as_candidates(candidates: DataFrame) -> DataFrame:
    score = F.coalesce("context_score", "cvss_score")
    band = F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low").otherwise("info")
    none = F.lit(None).cast("string")
    return candidates.withColumn("severity", band).withColumn("notes", F.concat(F.lit(CANDIDATE), _said("detail"))).withColumn("verdict", none).withColumn("verdict_confidence", none).withColumn("verdict_reason", none).withColumn("reasoning", none)


def _unconfirmed_framed(reports: DataFrame, counts: DataFrame, tool: str) -> DataFrame:
    n = F.coalesce("n", F.lit(0)).cast("string")
    head = F.concat(_title("name", tool), F.lit(f" — ASAN-Unconfirmed Candidates\n\n## Summary\n\n{UNCONFIRMED}\n\n- ASAN-unconfirmed candidates: "), n, F.lit("\n- Required disposition: manually reproduce before confirmation\n\n## Findings ("), n, F.lit(")\n\n"))
    return reports.join(counts, "scope", "left").select("scope", head.alias("head"), F.when(F.col("n").isNull(), "_None._\n").otherwise("").alias("tail"))


def _told(c: Column) -> Column:
    """Null for an empty text; within a condition ``nullif`` alone would work the text out twice."""
    return markdown.once(c, lambda x: F.nullif(x, F.lit("")))


def _field(name: str) -> Column:
    """What a line of ``part`` says, null without one; parts without the line's mark are not searched, others once."""
    rx, i = FIELDS[name]
    mark = re.sub(r"\\(.)", r"\1", re.match(r"\(\?mdU\)\^(\\\*\\\*.+?:\\\*\\\*)", rx)[1])
    said = _told(F.regexp_extract("part", rx, i))
    if name == "verdict_reason":  # may be empty
        said = F.when(F.col("part").rlike(rx), F.regexp_extract("part", rx, i))
    return F.when(F.contains("part", F.lit(mark)), said)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def parsed(reports: DataFrame) -> DataFrame:
    """One row for each finding of ``reports`` (scope, text): scope, place, index, severity, title, done, ref, file, line_start,
    line_end, the FIELDS (null where a line is missing or has another form), sections, snippet, body.

    A finding goes from its heading to the next one.  ``ref`` is its first file line; a ref without lines counts as lines
    0.  ``sections`` maps headings of the fourth level, in lower case, to their texts; what stands before the first is
    under the empty one, and of repeated ones the last counts.
    """
    return _read(reports.select("scope", F.posexplode(F.split(markdown.one_separator(F.col("text")), "(?=" + HEADER + ")")).alias("place", "part")).where(F.col("part").rlike(_HEADING)))


def parsed_parts(parts: DataFrame, near: int = 4096) -> DataFrame:
    """As :func:`parsed`, of reports in parts (scope, place, part), of which no row or task holds a whole one.

    Parts follow each other by ``place``, a whole number, and end at line ends; a finding may go on over parts and a part
    may hold several.  ``place`` of a finding is that of the part with its heading.  Parts meet in stretches of ``near``
    places; what stands before the first heading of a stretch belongs to the last one of an earlier stretch.
    """
    at, key = F.struct("place", "i"), ["scope", "_b"]
    cut = F.split(markdown.one_separator(F.col("part")), "(?=" + HEADER + ")")
    rows = parts.select("scope", "place", F.floor(F.col("place") / near).alias("_b"), F.posexplode(cut).alias("i", "part")).withColumn("_own", F.when(F.col("part").rlike(_HEADING), at))
    tops = rows.groupBy(*key).agg(F.max("_own").alias("_top"))
    tops = tops.select(*key, F.last("_top", True).over(Window.partitionBy("scope").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_own", True).over(Window.partitionBy(*key).orderBy("place", "i").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("_own", own).join(tops.hint("merge"), key).withColumn("_at", F.coalesce("_own", "_before")).where("_at is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "i", "part"))), lambda x: x["part"]), "\n")
    return _read(met.groupBy("scope", "_at").agg(text.alias("part")).select("scope", "_at.place", "part"))


def _read(rows: DataFrame) -> DataFrame:
    """Findings of ``rows`` (scope, place, part), each of which begins with its heading, which is not looked for further on."""
    heading = _HEADING
    get = lambda rx, i: F.regexp_extract("part", rx, i)
    ref = _told(_stripped(get(r"(?mdU)^[^\S\n]*\*\*File:\*\*\s*`([^`]+)`", 1)))
    place = lambda i: F.nullif(F.regexp_extract("ref", r"(?s)^(.*?):(\d+)(?:-(\d+))?$", i), F.lit(""))
    rows = rows.select("scope", "place", get(heading, 1).cast("int").alias("index"), F.upper(get(heading, 2)).alias("severity"), _stripped(get(heading, 3)).alias("title"), (get(heading, 4) != "").alias("done"), ref.alias("ref"), "part")
    first = place(2).cast("int")
    fields = [_field(name).alias(name) for name in FIELDS]
    pieces = F.transform(F.split("part", r"(?mdU)^####[^\S\n]+(?=\S)"), lambda x, i: F.struct(F.when(i == 0, "").otherwise(F.lower(_stripped(F.substring_index(x, "\n", 1)))).alias("k"), _stripped(F.when(i == 0, x).when(F.contains(x, F.lit("\n")), F.regexp_replace(x, r"\A[^\n]*\n", "")).otherwise("")).alias("v")))
    rows = rows.select("*", F.coalesce(F.trim(place(1)), "ref").alias("file"), F.coalesce(first, F.lit(0)).alias("line_start"), F.coalesce(place(3).cast("int"), first, F.lit(0)).alias("line_end"), *fields, pieces.alias("pieces"), _stripped(F.col("part")).alias("body"))
    known = F.array_distinct(F.col("pieces.k"))
    sections = F.map_from_arrays(known, F.transform(known, lambda k: F.element_at(F.filter("pieces", lambda p: p["k"] == k), -1)["v"]))
    return rows.withColumn("sections", sections).withColumn("snippet", F.regexp_extract("part", r"(?s)```[^\n]*\n(.*?)\n```", 1)).drop("part", "pieces")


def marked_done(reports: DataFrame, done: DataFrame) -> DataFrame:
    """``reports`` (scope, text) with a mark, which does not show, on the headings of ``done`` (scope, index, severity).

    A heading that bears the mark stays as it is, so doing it again changes nothing.
    """
    lines = reports.select("scope", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    index, severity = F.regexp_extract("line", HEADER, 1), F.upper(F.regexp_extract("line", HEADER, 2))
    lines = lines.withColumn("index", F.when(index != "", index.try_cast("int"))).withColumn("severity", F.when(index != "", severity)).withColumn("has", F.regexp_extract("line", HEADER, 4) != "")
    want = done.select("scope", F.col("index").cast("int").alias("index"), F.upper("severity").alias("severity"), F.lit(True).alias("want")).distinct()
    met = lines.join(want, ["scope", "index", "severity"], "left")
    line = F.when(F.col("want") & ~F.col("has"), F.concat(F.regexp_replace("line", r"(?U)\s+\z", ""), F.lit(f"  {DONE}"))).otherwise(F.col("line"))
    made = met.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("made"))
    return reports.join(made, "scope", "left").select("scope", F.coalesce("made", "text").alias("text"))
