"""Severity from bands, scores and labels, and how much effort a finding deserves."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least score of each severity, level and stand-in score of a severity, groups of words that make a chain hard to follow.
FLOORS = {"CRITICAL": 9.0, "HIGH": 7.0, "MEDIUM": 4.0}
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}
STAND_IN = {"CRITICAL": "9.0", "HIGH": "7.0", "MEDIUM": "4.0", "LOW": "0.1"}
HARD_WORDS = (
    ("async", "callback", "queue", "event loop", "stream"),
    ("thread", "race", "concurrent", "lifetime", "use-after-free"),
    ("backend", "gpu", "cuda", "rdma", "hardware", "accelerator"),
    ("server", "http", "network", "remote", "rpc", "websocket"),
    ("model", "fixture", "configuration", "feature flag", "plugin"),
)


def from_band(band: Column) -> Column:
    """CRITICAL to LOW for a band's name in any case; null for every other text."""
    name = F.upper(F.regexp_replace(band, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), name)


def resolve(context_band: Column, base_band: Column, label: Column) -> Column:
    """The band in context, else the base band, else the label."""
    return F.coalesce(from_band(context_band), from_band(base_band), label)


def from_score(context_score: Column, base_score: Column) -> Column:
    """Severity of the score in context, else of the base score; INFO without either."""
    score = F.coalesce(context_score, base_score)
    out = F.when(score.isNull(), "INFO")
    for name, least in FLOORS.items():
        out = out.when(score >= least, name)
    return out.otherwise("LOW")


def sarif_level(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(v)) for s, v in LEVELS.items()], F.lit("note"))


def security_severity(score: Column, severity: Column) -> Column:
    """The score with one place, or, of a negative or missing one, what stands for the severity."""
    known = F.when(score >= 0, F.format_string("%.1f", score))
    return F.coalesce(known, *[F.when(severity == s, F.lit(v)) for s, v in STAND_IN.items()], F.lit("0.0"))


def chain_complexity(text: Column, preconditions: Column, edges: Column) -> Column:
    """From 1 to 5: by arrows and hard words in the text, the number of preconditions and of related call edges."""
    low = F.lower(text)
    arrows = F.regexp_count(low, F.lit("->|→"))
    groups = reduce(add, [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), 1).otherwise(0) for words in HARD_WORDS])
    step = lambda condition: F.when(condition, 1).otherwise(0)
    score = 1 + step(arrows >= 2) + step(arrows >= 5) + step(preconditions >= 2) + F.least(F.lit(2), groups) + step(edges >= 5) + step(edges >= 15)
    return F.least(F.lit(5), score)


def scaled_floor(low: float, high: float, complexity: Column) -> Column:
    """Evenly from ``low`` at complexity 1 to ``high`` at 5."""
    return F.lit(low) + F.lit(high - low) * (F.greatest(F.lit(1), F.least(F.lit(5), complexity)) - 1) / 4
