"""States of fixes, labels and folder names of findings, spans of time, and selections typed by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons of states that are not counted as a fix.
DENIED = "policy gate denied automated remediation"
APPLIED = "remediation applied"
OPEN = "remediation not applied; needs review"
SKIPPED = {"validation_failed": "fix applied but failed validation; needs rework", "rejected": "finding rejected as a false positive"}
FIXED, PARTLY, NOT_FIXED = "Fixed", "Partially Fixed", "Not Fixed"


def fix_status(verdict: Column, mode: Column) -> Column:
    """State of a report after a pass; a null verdict needs review unless only reports are asked for."""
    landed = F.coalesce(verdict.isin(FIXED, PARTLY), F.lit(False))
    return F.when(verdict == "Denied", "deny").when(verdict == "False Positive", "rejected").when(mode == "report-only", "proposed").when(landed, "awaiting_validation").otherwise("needs_review")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def reported(status: Column, summary: Column, policy_reason: Column) -> tuple[Column, Column]:
    """(remediated, deny or skipped; the reason): the summary is the reason where there is one."""
    s = F.lower(F.coalesce(status, F.lit("")))
    done = s.isin("awaiting_validation", "proposed", "validated")
    named = F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in SKIPPED.items()], F.lit(OPEN))
    denied = F.coalesce(F.nullif(policy_reason, F.lit("")), _text(summary), F.lit(DENIED))
    bucket = F.when(s == "deny", "deny").when(done, "remediated").otherwise("skipped")
    return bucket, F.when(s == "deny", denied).otherwise(F.coalesce(_text(summary), F.when(done, APPLIED).otherwise(named)))


def readiness(verdict: Column) -> Column:
    return F.when(verdict == FIXED, "Ready").when(verdict == PARTLY, "Ready with Conditions").otherwise("Not Ready")


def answer(verdict: Column, asked: str) -> Column:
    """Yes where the verdict is the one asked for, else No."""
    return F.when(verdict == asked, "Yes").otherwise("No")


def final_status(verdict: Column) -> Column:
    """State of a report once its fix was judged; what is no verdict needs review."""
    return F.when(verdict == FIXED, "validated").when(verdict.isin(PARTLY, NOT_FIXED), "validation_failed").otherwise("needs_review")


def label(severity: Column, title: Column, file: Column) -> Column:
    place = F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit(" ("), file, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), severity, F.lit("] "), title, place)


def slug(index: Column, title: Column) -> Column:
    """The number in two digits at least, then the title in a-z, 0-9 and hyphens, 60 at most."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.regexp_replace(F.substring(plain, 1, 60), "-+$", "")
    number = index.cast("string")
    return F.concat(F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("_"), F.when(cut == "", "finding").otherwise(cut))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two ISO times; 0 if either does not parse."""
    at = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return F.coalesce((at(end) - at(start)) / 1e6, F.lit(0.0))


def file_stamp(time: Column) -> Column:
    """An ISO time to the second without the signs that file names can't hold."""
    return F.translate(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ":-", "")


def selected(text: Column, known: Column, done: Column) -> Column:
    """Places (from 0) in ``known``, an array of numbers, that a typed selection names, in the order named.

    Blank, q, quit and exit give null; ``all`` every place; ``pending`` those whose flag in ``done`` is false; else numbers
    and ranges ``a-b`` between commas and blanks.  What is neither, and unknown numbers, are passed over.  A range costs
    no more than ``known`` is long.
    """
    whole = F.struct(F.lower(F.trim(F.coalesce(text, F.lit("")))).alias("t"), known.alias("known"), done.alias("done"), F.array_sort(F.transform(known, lambda k, i: F.struct(k.alias("k"), i.alias("i")))).alias("sorted"))
    return _once(whole, _chosen)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used, also inside of loops."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chosen(s: Column) -> Column:
    """The selection of (t, known, done, sorted: known numbers with their places, in order)."""
    t, known, done = s["t"], s["known"], s["done"]
    every = F.when(F.size(known) > 0, F.sequence(F.lit(0), F.size(known) - 1)).otherwise(F.array().cast("array<int>"))
    # a number is a range of its own
    ends = lambda token: F.regexp_extract_all(token, F.lit(r"^(\d{1,18})(?:-(\d{1,18}))?$"), F.lit(0))
    bounds = lambda token: F.transform(F.split(token, "-"), lambda x: x.try_cast("long"))

    def places(token: Column) -> Column:
        inside = lambda b: F.filter(s["sorted"], lambda x: x["k"].between(F.get(b, F.lit(0)), F.element_at(b, -1)))
        return F.flatten(F.transform(ends(token), lambda x: _once(bounds(x), lambda b: F.transform(inside(b), lambda x: x["i"]))))

    named = F.coalesce(F.array_distinct(F.flatten(F.transform(F.split(t, r"[,\s]+"), places))), F.array().cast("array<int>"))
    left = F.filter(every, lambda i: ~F.get(done, i))
    return F.when(t.isin("q", "quit", "exit", ""), None).when(t == "all", every).when(t == "pending", left).otherwise(named)
