"""Unified diffs of two versions of a text, written and applied."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The line that marks diffs without a version control system, and git's mark of a missing line end.
HEADER = "# (synthesized diff — target is not a git repository)\n"
NO_END = "\\ No newline at end of file"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _diff(before: str | None, after: str | None, path: str | None, exact: bool) -> str | None:
    old, new = before or "", after or ""
    if path is None or old == new:
        return None
    cut = (lambda t: [x for x in re.split(r"(?<=\n)", t) if x]) if exact else (lambda t: t.splitlines(keepends=True))
    ends = difflib.unified_diff(cut(old), cut(new), "/dev/null" if before is None else f"a/{path}", f"b/{path}" if new else "/dev/null")
    said = (x if not exact or x.endswith("\n") else f"{x}\n{NO_END}\n" for x in ends)
    body = "".join(said)
    return f"diff --git a/{path} b/{path}\n{body}" + ("" if body.endswith("\n") else "\n")


def _udf(exact: bool):
    @F.pandas_udf(StringType())
    def written(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([_diff(b, a, p, exact) for b, a, p in zip(before, after, path, strict=True)], dtype=object)

    return written


def diff(before: Column, after: Column, path: Column, exact: bool = False) -> Column:
    """The unified diff of one file's two versions, with three lines around each change; null if they are the same.

    A null ``before`` is a new file; an empty or null ``after`` has gone.  Lines end as :meth:`str.splitlines` tells, and
    a last line without an end gets one, so that diffs can be joined; of two such lines in a row the first one has none.
    With ``exact`` only ``\\n`` ends lines and a missing end is marked as git does, so that :func:`applied` gives back
    ``after`` to the byte.  Matching blocks of lines are searched text by text; no built-in aligns two lists.
    """
    return _udf(exact)(before, after, path)


def _applied(before: str | None, said: str | None) -> str | None:
    if said is None:
        return before
    old = [x for x in re.split(r"(?<=\n)", before or "") if x]
    out, at, rows = [], 0, said.split("\n")
    i = 0
    while i < len(rows):
        hunk = _HUNK.match(rows[i])
        i += 1
        if hunk is None:
            continue
        first, many, _, news = (int(x) if x is not None else 1 for x in hunk.groups())
        start = first - 1 if many else first
        if start < at:
            return None
        out += old[at:start]
        at = start
        while many > 0 or news > 0:
            if i >= len(rows) or rows[i][:1] not in (" ", "-", "+"):
                return None
            sign, text = rows[i][:1], rows[i][1:]
            i += 1
            if i < len(rows) and rows[i].startswith("\\"):
                i += 1
            else:
                text += "\n"
            if sign != "+":
                if at >= len(old) or old[at] != text:
                    return None
                at += 1
                many -= 1
            if sign != "-":
                out.append(text)
                news -= 1
    return "".join(out + old[at:])


@F.pandas_udf(StringType())
def _apply(before: pd.Series, said: pd.Series) -> pd.Series:
    return pd.Series([_applied(b, d) for b, d in zip(before, said, strict=True)], dtype=object)


def applied(before: Column, said: Column) -> Column:
    """A text after one file's exact diff; itself where the diff is null; null if the diff does not fit it."""
    return _apply(before, said)


def changed_lines(said: Column) -> Column:
    """(added, removed, hunks) of one file's diff."""
    rows = F.filter(F.split(said, "\n"), lambda x, i: i >= 3)
    many = lambda sign: F.size(F.filter(rows, lambda x: x.startswith(sign)))
    return F.struct(many("+").alias("added"), many("-").alias("removed"), many("@@").alias("hunks"))
