"""Ids, qualified names, sizes and shortened texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of a chunk in lines of code, and lengths of a shortened text.
SMALL, MEDIUM = 2000, 8000
LONGEST, HEAD, TAIL, CUT = 1800, 900, 700, "\n...<truncated>...\n"


def size_class(loc: Column) -> Column:
    return F.when(loc < SMALL, "small").when(loc < MEDIUM, "medium").otherwise("large")


def shorten_middle(text: Column) -> Column:
    """Texts without the white space around them; long ones keep their head and tail, with a mark between."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > LONGEST, F.concat(F.left(bare, F.lit(HEAD)), F.lit(CUT), F.right(bare, F.lit(TAIL)))).otherwise(bare)


def qualify(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), name)


def qualified_file(name: Column) -> Column:
    """What stands before the last ``::``; empty without one."""
    return F.when(F.instr(name, "::") > 0, F.regexp_extract(name, r"(?s)^(.*)::", 1)).otherwise("")


def qualified_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def short_id(*parts: Column) -> Column:
    """Six hex digits of the SHA-1 of the parts, joined by NUL."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 6)


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))
