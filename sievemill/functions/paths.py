"""Paths, references to lines, and lists of names."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixed(path: Column, prefix: str) -> Column:
    """The path below ``prefix``, unless it is there already; null and empty stay."""
    return F.when((path == "") | path.startswith(prefix + "/"), path).otherwise(F.concat(F.lit(prefix + "/"), path))


def prefixed_reference(ref: Column, prefix: str) -> Column:
    """``file:line`` with its file part below ``prefix``."""
    return F.concat(prefixed(F.substring_index(ref, ":", 1), prefix), F.regexp_extract(ref, r"(?s)(:.*)$", 1))


def affected(files: Column, least: int = 3) -> Column:
    """Names longer than ``least`` that are no comment, joined."""
    return F.array_join(F.filter(files, lambda x: ~x.startswith("//") & (F.length(x) > least)), ", ")


def name_list(names: Column, lower: bool = False) -> Column:
    """Names without blanks and slashes around them, each once, where it came first; empty ones and nulls go."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"^[/\\]+|[/\\]+$", "")
    kept = F.filter(F.transform(names, lambda x: F.lower(bare(x)) if lower else bare(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def name_hit(name: Column, patterns: list[str]) -> Column:
    """The first shell pattern that the whole name matches in any case, else null."""
    regex = lambda p: fnmatch.translate(p.lower()).replace(r"\Z", r"\z")
    return F.coalesce(*[F.when(F.lower(name).rlike("^" + regex(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def suffixes(path: Column) -> Column:
    """The path and all that is left of it behind each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
