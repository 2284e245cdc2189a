"""Shell-style patterns as anchored regular expressions, compiled when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """``*`` also crosses ``/``; ``**/x`` also matches ``x`` at the root; ``[!x]`` negates."""
    optional = pattern.startswith("**/")
    body = pattern[3:] if optional else pattern
    out, i = "", 0
    while i < len(body):
        c = body[i]
        close = body.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = body[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return "(?s)^" + ("(.*/)?" if optional else "") + out + "$"


def first_hit(path: str | Column, patterns: list[str]) -> Column:
    """The first pattern that matches, else null."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(*[F.when(c.rlike(to_regex(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))
