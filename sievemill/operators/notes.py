"""Notes within Markdown reports: lines that are added, replaced or kept by place, so that doing it again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import cvss, markdown
from sievemill.operators import matching
from sievemill.operators.rounds import written

# Lines of a report that notes depend on, and what they say.
VECTOR_LINE = r"^\*\*(?:CVSS|Base Vector).*?`([^`]+)`"
PLAIN_VECTOR = r"^CVSS\s*3\.[01].*?(CVSS:3\.[01]/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH])"
SCORED = r"(?:`[^`]+`.*?\b\d{1,2}\.\d\b)|(?:\*\*\d{1,2}\.\d\*\*)"
CONTEXT_LINE = r"^\*?\*?VulContextSeverity:"
PRIORITY_LINE = r"^\*?\*?(?:OffensivePriority|PentestPriority):"
FINDING_LINE = r"^[#\s\d.]*\[(CRITICAL|HIGH|MEDIUM|LOW|INFO)]\s+(.+)$"
REST_LINE = r"(?i)^#{0,3}\s*(?:Dropped Findings|Exploit Chains|Appendix)\b"
PRIORITIES = {"P1": "Externally Exploitable, No Auth", "P2": "Externally Exploitable, Obtainable Auth", "P3": "Internal Network / Privileged Position", "P4": "Code-Knowledge / Insider Dependent"}
SUMMARY = r"(?s)## Remediation Summary\n.*?(?=\n#{1,6} |\z)"
HEADING = r"(?mdU)^### \d+\. \[[^\]]*\]\s*(.+?)\s*$"
SECTION = r"(?s)\n+### Remediation\n.*\z"
NOT_PROCESSED = "finding not processed for remediation"
APPROACH = {"remediated": "Automated fix applied by the Remediation Agent and written as a unified diff; awaiting validation.", "deny": "Policy gate denied automated patching; guidance-only — a human must remediate."}
NO_APPROACH = "No automated patch applied."


def _lines(reports: DataFrame) -> DataFrame:
    """Lines of each report with what comes before and after: ``rest`` once the findings have ended, ``next`` the next line
    that is not blank."""
    rows = reports.select("scope", F.posexplode(markdown.lines(F.col("text"))).alias("n", "line"))
    up, down = Window.partitionBy("scope").orderBy("n"), Window.partitionBy("scope").orderBy(F.desc("n"))
    full = ~F.col("line").rlike(r"(?U)^\s*$")
    rows = rows.withColumn("full", full).withColumn("rest", F.max(F.col("line").rlike(REST_LINE)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("next", F.coalesce(F.last(F.when(F.col("full"), F.col("line")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))


def _joined(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(scope, text, changed): each line's ``out`` (an array of lines) in order; a report without a change keeps its text."""
    ordered = F.sort_array(F.collect_list(F.struct("n", "out")))
    made = rows.groupBy("scope").agg(F.array_join(F.flatten(F.transform(ordered, lambda x: x["out"])), "\n").alias("made"), F.max("change").alias("changed"))
    out = reports.select("scope", "text").join(made, "scope", "left")
    changed = F.coalesce("changed", F.lit(False))
    return out.select("scope", F.when(changed, F.concat("made", F.lit("\n"))).otherwise(F.col("text")).alias("text"), changed.alias("changed"))


def score_notes(reports: DataFrame, apps: DataFrame) -> DataFrame:
    """Adds the base score to each vector line of ``reports`` (scope, text), and the context severity on a line after it.

    ``apps`` (scope, external, pci, pan, pii) has at most one row a scope; reports without one get no context lines.  A
    context line that is already the next line is replaced, with the blanks before it.  Lines from the first heading of
    dropped findings, chains or an appendix on are left alone, as are vectors that can't be scored.  Null texts stay.
    """
    marked = F.regexp_extract("line", VECTOR_LINE, 1)
    bold = (marked != "") & ~F.col("line").rlike(CONTEXT_LINE)
    rows = _lines(reports).withColumn("bold", bold)
    vector = F.when(F.col("bold"), marked).otherwise(F.nullif(F.regexp_extract("line", PLAIN_VECTOR, 1), F.lit("")))
    rows = rows.withColumn("vector", F.when(~F.col("rest"), vector)).join(apps.select("scope", "external", "pci", "pan", "pii"), "scope", "left")
    flags = [F.col(c) for c in ("external", "pci", "pan", "pii")]
    rows = rows.withColumn("base", cvss.base_score(F.col("vector"))).withColumn("score", F.when(F.col("external").isNotNull(), cvss.environmental_score(F.col("vector"), *flags)))
    number, said = F.format_string("%.1f", "score"), cvss.environmental_vector(F.col("vector"), *flags)
    note = F.when(F.col("bold"), F.concat(F.lit("**VulContextSeverity:** `"), said, F.lit("` - **"), number, F.lit(" ("), cvss.rating(F.col("score")), F.lit(")**")))
    note = note.otherwise(F.concat(F.lit("VulContextSeverity: "), number, F.lit(" ("), cvss.rating(F.col("score")), F.lit(") - "), said))
    rows = rows.withColumn("note", F.when(F.col("score").isNotNull(), note)).withColumn("has", F.col("next").rlike(CONTEXT_LINE))
    before = Window.partitionBy("scope").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.last(F.when(F.col("full"), F.col("note").isNotNull() & F.col("has")), ignorenulls=True).over(before)
    rows = rows.withColumn("gone", F.coalesce(replaced, F.lit(False)))
    scores = F.col("bold") & F.col("vector").isNotNull() & F.col("base").isNotNull() & ~F.col("line").rlike(SCORED)
    line = F.when(scores, F.concat("line", F.lit(" - **"), F.format_string("%.1f", "base"), F.lit("**"))).otherwise(F.col("line"))
    out = F.when(F.col("gone"), F.array().cast("array<string>")).when(F.col("note").isNotNull(), F.array(line, F.lit(""), "note")).otherwise(F.array(line))
    change = scores | (F.col("note").isNotNull() & ~(F.col("has") & (F.col("next") == F.col("note"))))
    return _joined(rows.select("scope", "n", out.alias("out"), F.coalesce(change, F.lit(False)).alias("change")), reports)


def priority_notes(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds the priority of each finding to ``reports`` (scope, text), after its context line, else after its vector line.

    ``findings`` (scope, place, priority, reason) are those of the report's headings, from 0 in their order; a finding
    without a priority gets none, nor one whose note is there already.  Only a finding's first such line counts.
    """
    rows = _lines(reports)
    up = Window.partitionBy("scope").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.sum((~F.col("rest") & F.col("line").rlike(FINDING_LINE)).cast("long")).over(up) - 1)
    context = F.col("line").rlike(CONTEXT_LINE)
    vector = ~context & ~F.col("line").rlike(PRIORITY_LINE) & (F.col("line").rlike(VECTOR_LINE) | F.col("line").rlike(PLAIN_VECTOR))
    fits = ~F.col("rest") & (F.col("place") >= 0) & (context | (vector & ~F.col("next").rlike(CONTEXT_LINE)))
    rows = rows.withColumn("first", F.min(F.when(fits, F.col("n"))).over(Window.partitionBy("scope", "place")) == F.col("n"))
    met = rows.join(findings.select("scope", F.col("place").cast("long").alias("place"), "priority", "reason"), ["scope", "place"], "left")
    label = F.lit("")
    for k, v in PRIORITIES.items():
        label = F.when(F.col("priority") == k, v).otherwise(label)
    reason = F.coalesce("reason", F.lit("None"))
    bold = F.concat(F.lit("**OffensivePriority:** **"), "priority", F.lit("** - "), label, F.lit(" | *"), reason, F.lit("*"))
    plain = F.concat(F.lit("OffensivePriority: "), "priority", F.lit(" - "), label, F.lit(" ("), reason, F.lit(")"))
    change = F.coalesce(F.col("first") & (F.col("priority") != "") & ~F.col("next").rlike(PRIORITY_LINE), F.lit(False))
    note = F.when(F.col("line").startswith("**"), bold).otherwise(plain)
    out = F.when(change, F.array("line", F.lit(""), note)).otherwise(F.array("line"))
    return _joined(met.select("scope", "n", out.alias("out"), change.alias("change")), reports)


def _stripped(name: str) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+\z", "")


def _escaped(text: Column) -> Column:
    """Text without control characters that can't form Markdown or HTML."""
    one = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "\r\n|[\r\n]", " ")
    return _entities(F.regexp_replace(one, r"([\\`*_\[\]|#])", r"\\$1"))


def _entities(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _code(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f`]", ""), "[\r\n]", " ")
    return F.concat(F.lit("`"), _entities(plain), F.lit("`"))


def fix_sections(reports: DataFrame, fixes: DataFrame) -> DataFrame:
    """Puts a section on its fix under each finding of ``reports`` (scope, text), and a summary at the end.

    ``fixes`` (scope, id, title, state, reason, summary, files, rejected): ``state`` is remediated, deny or skipped.  A
    heading takes the fix that :func:`matching.match_titles` gives, else it is skipped.  Earlier sections and summaries
    are replaced.  A report without a finding's heading stays as it is.  A text is held whole, so for reports that may not
    fit :func:`fix_section_parts` gives what they are made of.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("step", "place", "part"))), lambda x: x["part"])
    made = fix_section_parts(reports, fixes).where("part is not null").groupBy("scope").agg(F.array_join(ordered, "").alias("text"))
    return reports.select("scope").join(made, "scope", "left")


def fix_section_parts(reports: DataFrame, fixes: DataFrame) -> DataFrame:
    """(scope, step, place, part): the texts of :func:`fix_sections` in parts, which follow each other by step, then place.

    Parts are written once and read to find their fixes and to be told; a fix's section is a part of its own, so the text
    of a report is not joined with anything.
    """
    bare = F.concat(F.regexp_replace(F.regexp_replace("text", SUMMARY, ""), r"(?U)\s+\z", ""), F.lit("\n"))
    pieces = reports.select("scope", "text", F.split(bare, "(?=" + HEADING.replace("(.+?)", ".+?") + ")").alias("pieces"))
    headed = F.size("pieces") > F.when(F.regexp_extract(F.get("pieces", F.lit(0)), HEADING, 1) != "", 0).otherwise(1)
    pieces = pieces.select("scope", headed.alias("headed"), F.posexplode(F.when(headed, F.col("pieces")).otherwise(F.array("text"))).alias("n", "part"))
    title = F.when(F.col("headed"), F.nullif(F.regexp_extract("part", HEADING, 1), F.lit("")))
    parts = written(pieces.select("scope", "headed", F.col("n").cast("long").alias("n"), title.alias("title"), "part"))
    heads = matching.match_titles(parts.where("title is not null").select("scope", "n", "title"), fixes.select("scope", "id", "title"), "scope").select("scope", "n", F.col("report").alias("id"))
    met = heads.join(fixes.drop("title").hint("merge"), ["scope", "id"], "left")
    state, reason = F.coalesce("state", F.lit("skipped")), F.when(F.col("id").isNull(), NOT_PROCESSED).otherwise(_stripped("reason"))
    said = F.coalesce(F.nullif(_stripped("summary"), F.lit("")), F.nullif(reason, F.lit("")), F.lit("n/a"))
    approach = F.lit(NO_APPROACH)
    for k, v in APPROACH.items():
        approach = F.when(state == k, v).otherwise(approach)
    files = F.array_distinct(F.filter(F.coalesce("files", F.array().cast("array<string>")), lambda f: f != ""))
    listed = F.when(F.size(files) > 0, F.transform(files, lambda f: F.concat(F.lit("  - "), _code(f)))).otherwise(F.array(F.lit("  - (no files changed)")))
    block = F.concat(F.lit("\n\n### Remediation\n- **Status:** "), _escaped(state), F.lit("\n- **Summary:** "), _escaped(said), F.lit("\n- **Approach:** "), approach, F.lit("\n- **Details of what was remediated:**\n"), F.array_join(listed, "\n"), F.lit("\n\n"))
    at = lambda rows, place, part: rows.select("scope", F.col("n").alias("step"), F.lit(place).alias("place"), part.alias("part"))
    kept = F.regexp_replace(F.regexp_replace("part", SECTION, ""), r"(?U)\s+\z", "")
    own = at(parts, 0, F.when(F.col("title").isNull(), F.col("part")).otherwise(kept))
    count = fixes.groupBy("scope").agg(F.count("*").alias("total"), F.count_if("rejected").alias("no"), F.count_if(F.col("state") == "remediated").alias("done"))
    every = [F.coalesce(c, F.lit(0)) for c in ("total", "no", "done")]
    total, no, done = every
    rate = F.when(total > 0, F.concat(F.bround(done / total * 100, 0).cast("long").cast("string"), F.lit("%"))).otherwise("n/a")
    number = lambda c: c.cast("string")
    end = F.concat(F.lit("\n## Remediation Summary\n- Total findings (true positive): "), number(total - no), F.lit("\n- Findings in scope for remediation: "), number(total), F.lit("\n- Remediated: "), number(done), F.lit("\n- Success Rate(remediated/true positive): "), rate, F.lit("\n"))
    last = parts.where("headed and n = 0").select("scope", F.lit(2**62).alias("n")).join(count, "scope", "left")
    return own.unionByName(at(met, 1, block)).unionByName(at(last, 2, end))
