"""Repairs of loosely typed values: bad input becomes a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(raw: Column, default: float = 0.5) -> Column:
    """A share from 0 to 1: whole numbers from 2 to 10 are tenths, other ones from 2 to 100 are percent, a percent sign says nothing."""
    text = F.trim(F.regexp_replace(F.trim(raw), "%+$", ""))
    value = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    scaled = F.when((value >= 2) & (value <= 10) & (value == F.floor(value)), value / 10).when((value >= 2) & (value <= 100), value / 100).otherwise(value)
    bad = value.isNull() | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def enum(raw: Column, members: list[str], aliases: dict[str, str], default: str) -> Column:
    """A member by its very spelling or in lower case with ``_`` for hyphens and blanks, else by alias (spelt so), else the default.

    White space around a value does not count; null and empty are the default.
    """
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+\z", "")
    plain = F.translate(F.lower(bare), "- ", "__")
    out = F.when(bare.isin(members), bare).when(plain.isin(members), plain)
    for alias, member in aliases.items():
        out = out.when(plain == alias, F.lit(member))
    return out.otherwise(F.lit(default))


def cwe(raw: Column) -> Column:
    """``CWE-<digits>`` from a spelled-out or bare number, else null."""
    digits = F.regexp_extract(raw, r"(?i)(?:CWE[-\s]?|^\s*)(\d{1,5})\b", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


def normalized_id(raw: Column) -> Column:
    """An identifier without surrounding blanks and leading zeros; blank is null."""
    text = F.regexp_replace(F.trim(raw), "^0+(?=.)", "")
    return F.when(text != "", text)
