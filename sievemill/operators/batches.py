"""Summaries of batches of repositories, and the gates that a run has left for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import markdown, paths
from sievemill.operators.reports import TOOL

# Fixed value: who is named before the host of an address.
USER = r"(?U)(\w[\w+.\-]*://)[^/@\s]+@"


def without_user(text: Column) -> Column:
    """Addresses without the user and the secret before their host."""
    return F.regexp_replace(text, USER, "$1***@")


def _seconds(c: str) -> Column:
    """Whole seconds, halves to the even one."""
    return F.bround(F.col(c).cast("double"), 0).cast("long").cast("string")


def summaries(batches: DataFrame, results: DataFrame, tool: str = TOOL) -> DataFrame:
    """(batch, text): a table of all repositories of a batch in Markdown, then what has failed.

    ``batches`` (batch, list_file, elapsed), ``results`` (batch, ord, app, module, status, findings, elapsed, report, ref,
    error); what is not ``OK`` has failed.  No cell can hold a line or a bar of its own, nor who is named in an address.
    """
    cell = lambda c: markdown.cell(F.col(c))
    safe = lambda c: markdown.cell(without_user(F.col(c)))
    report = F.when(F.coalesce("report", F.lit("")) != "", F.concat(F.lit("`"), cell("report"), F.lit("`"))).otherwise("")
    row = F.concat_ws(" | ", cell("app"), cell("module"), cell("status"), F.coalesce(F.col("findings").cast("string"), F.lit("0")), _seconds("elapsed"), report, safe("ref"))
    failed = F.col("status") != "OK"
    lost = F.concat(F.lit("### "), cell("module"), F.lit(" (app "), cell("app"), F.lit(")\n- Source: `"), safe("ref"), F.lit("`\n- Error: "), safe("error"), F.lit("\n\n"))
    listed = F.array_sort(F.collect_list(F.struct("ord", row.alias("row"), F.when(failed, lost).alias("lost"))))
    got = results.groupBy("batch").agg(listed.alias("rows"), F.count("*").alias("n"), F.count_if(~failed).alias("ok"))
    lines = F.transform("rows", lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x["row"], F.lit(" |\n")))
    parts = F.array_join(F.array_compact(F.transform("rows", lambda x: x["lost"])), "")
    met = batches.join(got, "batch", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    text = F.concat(
        F.lit(f"# {tool} batch summary\n\n- Input list: `"), F.coalesce("list_file", F.lit("")), F.lit("`\n- Repos: "), n.cast("string"), F.lit(" ("), ok.cast("string"), F.lit(" OK, "), (n - ok).cast("string"), F.lit(" failed)\n- Total elapsed: "), _seconds("elapsed"),
        F.lit("s\n\n| # | App ID | Repo | Status | Findings | Elapsed (s) | Report | Source |\n|--:|---|---|---|--:|--:|---|---|\n"), F.coalesce(F.array_join(lines, ""), F.lit("")), F.when(n > ok, F.concat(F.lit("\n## Failures\n\n"), parts)).otherwise(""),
    )
    return met.select("batch", text.alias("text"))


def gate_lists(left: DataFrame) -> DataFrame:
    """(scope, tracking_id, gates, dropped): the gates, as a JSON list, that a text (scope, text) has for each finding.

    A text is a JSON list of objects; an entry whose ``gates`` are no list is dropped, and ``dropped`` counts these for the
    scope.  Of repeated ids the last entry counts; a missing id is empty, a null one ``None``.  A text that is null, no JSON
    or no list has no findings: what is not proven counts as not done.  A string that holds an object is read as one.
    """
    entry = F.when(F.col("text").rlike(r"\A\s*\["), F.from_json("text", "array<string>"))
    rows = left.select("scope", F.posexplode(entry).alias("n", "e"))
    gates = F.get_json_object("e", "$.gates")
    known = F.get_json_object("e", "$.tracking_id")
    null = F.col("e").rlike(r'"tracking_id"\s*:\s*null')
    tracking = F.coalesce(known, F.when(null, "None"), F.lit(""))
    good = F.coalesce(F.col("e").startswith("{") & F.ltrim(gates).startswith("["), F.lit(False))
    rows = rows.select("scope", "n", good.alias("good"), tracking.alias("tracking_id"), gates.alias("gates"))
    bad = rows.groupBy("scope").agg(F.count_if(~F.col("good")).alias("dropped"))
    return rows.where("good").groupBy("scope", "tracking_id").agg(F.max_by("gates", "n").alias("gates")).join(bad, "scope")


#: Fixed value: the severity of a result that states none.
NO_SEVERITY = "Medium"


def filled_results(results: DataFrame, manifests: DataFrame) -> DataFrame:
    """Results (scope, tracking_id, title, description, severity, files) with what is blank taken from their manifest.

    ``manifests`` (scope, tracking_id, title, category, severity, files, ticket) has at most one row a scope; a result
    without one, or whose manifest has no finding (a null title), stays.  A tracking id that is blank or the ticket's
    becomes the manifest's, else the ticket's; ``Medium`` gives way to a stated severity; files are those longer than
    three characters that are no comment.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    m = manifests.select("scope", *[F.col(c).alias(f"_{c}") for c in ("tracking_id", "title", "category", "severity", "files", "ticket")]).where("_title is not null")
    met = results.join(m, "scope", "left").withColumn("_has", F.col("_title").isNotNull())
    said = F.regexp_replace(F.replace(F.coalesce("_category", F.lit("")), F.lit("\\n"), F.lit(" ")), r"(?U)^\s+|\s+\z", "")
    own = F.coalesce(F.nullif(F.col("_tracking_id"), F.lit("")), F.col("_ticket"))
    values = {
        "title": (blank("title"), F.col("_title")), "description": (blank("description"), said), "severity": ((F.col("severity") == NO_SEVERITY) & ~blank("_severity"), F.col("_severity")),
        "files": (blank("files"), paths.affected(F.coalesce("_files", F.array().cast("array<string>")))), "tracking_id": (blank("tracking_id") | F.col("tracking_id").eqNullSafe(F.col("_ticket")), own),
    }
    return met.select(*[F.when(F.col("_has") & values[c][0], values[c][1]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in results.columns])
