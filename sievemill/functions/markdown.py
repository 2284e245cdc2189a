"""Texts that go into Markdown, and stretches of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_FENCE = r"(?mdU)(?=^[^\S\n]{0,3}(?:```|~~~))"
_HEADING = r"(?mdU)^([^\S\n]{0,3})#{1,6}[ \t]+(.*?)[^\S\n]*$"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def one_separator(text: Column) -> Column:
    """The text with ``\\n`` between its lines, whatever ended them, and none after the last."""
    return F.regexp_replace(F.regexp_replace(text, _SEPARATORS, "\n"), r"\n\z", "")


def lines(text: Column) -> Column:
    """The lines of a text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(one_separator(text), "\n"))


def cell(text: Column) -> Column:
    """One cell of a table: no line ends, bars escaped; null is empty."""
    return F.coalesce(F.regexp_replace(F.replace(F.translate(text, "\r\n", "  "), F.lit("|"), F.lit("\\|")), r"(?U)^\s+|\s+$", ""), F.lit(""))


def demote_headings(text: Column) -> Column:
    """Headings outside code fences become bold lines.

    The text is cut before each fence, so that every second part lies in a fence: one pass, no state for each line.
    """
    parts = F.split(F.concat(F.lit("\n"), one_separator(text)), _FENCE)
    done = F.transform(parts, lambda part, i: F.when(i % 2 == 0, F.regexp_replace(part, _HEADING, "$1**$2**")).otherwise(part))
    return F.when(text == "", text).otherwise(F.substr(F.array_join(done, ""), F.lit(2)))


def excerpt(text: Column, name: Column, hint: Column, after: int) -> Column:
    """(excerpt, first): numbered lines from two before to ``after`` behind the anchor, which is the hinted line or, if that
    is none, the first with the name and a bracket; without an anchor null and 0."""


    def around(rows: Column, anchor: Column) -> Column:
        first = F.when(anchor.isNotNull(), F.greatest(F.lit(1), anchor - 2))
        last = F.least(F.size(rows), anchor + after - 1)
        body = F.transform(F.slice(rows, first.cast("int"), (last - first + 1).cast("int")), lambda x, i: F.format_string("%5d| %s", i + first, x))
        return F.struct(F.array_join(body, "\n").alias("excerpt"), F.coalesce(first, F.lit(0)).alias("first"))

    def of(rows: Column) -> Column:
        called = F.nullif(F.array_position(F.transform(rows, lambda x: F.contains(x, name) & F.contains(x, F.lit("(")) & (name != "")), True), F.lit(0))
        anchor = F.coalesce(F.when((hint > 0) & (hint <= F.size(rows)), hint.cast("long")), called)
        return once(anchor, lambda a: around(rows, a))

    return once(lines(text), of)
