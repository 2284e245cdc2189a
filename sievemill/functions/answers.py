"""Reads what reviewers write: verdict lines, duplicate lines and JSON inside prose."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lines and vectors that an answer must hold.
VERDICT_LINE = r"(?i)VERDICT:\s*(TRUE_POSITIVE|FALSE_POSITIVE)\s*\(confidence:\s*(\d{1,2})\s*/\s*10\)\s*(?:[-—–:]\s*)?(.*)"
VECTOR = r"CVSS:3\.[01]/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH]"
DUPLICATE_LINE = r"(?i)index\s*=\s*(\d+)\s+is_duplicate\s*=\s*(true|false)\s+canonical\s*=\s*(-?\d+)\s+reasoning\s*=\s*\"([^\"]*)\""
NO_VERDICT, NO_REASON = "verifier output unparseable", "(no reason given)"
#: Characters of a text that are searched for JSON.
MOST_JSON = 5_000_000


def verdicts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds verdict, confidence (0 to 10), reason, vector and reasoning.

    The last line with a verdict holds; without one it is FALSE_POSITIVE with confidence 0.  The vector is the
    first from that line on, else the last one of the text; null without any.  A null text is an empty one.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    lines = rows.withColumn("_lines", F.split(body, r"\r\n|\r|\n"))
    hits = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(VERDICT_LINE), i + 1)), lambda x: x.isNotNull())
    at = lines.withColumn("_at", F.array_max(hits))
    line = at.withColumn("_line", F.get("_lines", F.col("_at") - 1)).withColumn("_from", F.coalesce("_at", F.size("_lines") + 1))
    part = lambda n: F.regexp_extract("_line", VERDICT_LINE, n)
    found = F.col("_at").isNotNull()
    after = F.array_join(F.slice("_lines", F.col("_from"), F.size("_lines") + 1), "\n")
    first, every = F.regexp_extract(after, VECTOR, 0), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(VECTOR), F.lit(0))
    return line.withColumns({
        "verdict": F.when(found, F.upper(part(1))).otherwise("FALSE_POSITIVE"),
        "confidence": F.when(found, F.least(part(2).try_cast("int"), F.lit(10))).otherwise(0),
        "reason": F.when(found, F.when(F.trim(part(3)) != "", F.trim(part(3))).otherwise(NO_REASON)).otherwise(NO_VERDICT),
        "vector": F.when(first != "", first).otherwise(F.try_element_at(every, F.lit(-1))),
        "reasoning": F.regexp_replace(F.array_join(F.slice("_lines", F.lit(1), F.col("_from") - 1), "\n"), r"^\s+|\s+$", ""),
    }).drop("_lines", "_at", "_line", "_from")


def duplicate_lines(rows: DataFrame, n: int, text: str = "text") -> DataFrame:
    """A row (dup, canonical, reasoning) beside the others for each line that names a smaller canonical of ``n`` findings."""
    line = rows.select(*[c for c in rows.columns if c != text], F.explode(F.regexp_extract_all(F.col(text), F.lit(DUPLICATE_LINE), F.lit(0))).alias("_line"))
    part = lambda i: F.regexp_extract("_line", DUPLICATE_LINE, i)
    out = line.withColumns({"dup": part(1).try_cast("long"), "canonical": part(3).try_cast("long"), "reasoning": F.trim(part(4)), "_is": F.lower(part(2)) == "true"})
    return out.where("_is and canonical >= 0 and canonical < dup and dup < " + str(int(n))).drop("_line", "_is")


_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
_OPENED = re.compile(r"^```\w*\s*")
_STEPS = {"{": re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', re.DOTALL), "[": re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[\[\]]', re.DOTALL)}
_LOOSE = re.compile(r'\\(?:(["\\/nrtu])|)')


_OPENER = re.compile(r"[{\[]")


def _balanced(text: str, at: int, ends: dict[int, int]) -> str | None:
    """From a bracket to the one that closes it, outside strings.

    ``ends`` keeps where the brackets met on the way close, 0 for nowhere: a text of brackets that never close is gone
    through once for them all, or once more for those that stand within another's strings.
    """
    if at not in ends:
        open_: list[int] = []
        for step in _STEPS[text[at]].finditer(text, at):
            if len(mark := step.group()) != 1 or mark == '"':
                continue
            if mark == text[at]:
                open_.append(step.start())
                continue
            ends[open_.pop()] = step.end()
            if not open_:
                break
        ends |= dict.fromkeys(open_, 0)
    return text[at : ends[at]] if ends[at] else None


def _value(span: str):
    """The value of a span, also where a backslash stands before what it may not; None if it is none."""
    for spelt in (span, _LOOSE.sub(lambda m: m.group() if m.group(1) else "\\\\", span)):
        try:
            return json.loads(spelt)
        except ValueError:
            continue
    return None


def _values(part: str) -> Iterator:
    at, ends = 0, {}
    while opened := _OPENER.search(part, at):
        at = opened.start()
        span = _balanced(part, at, ends)
        value = None if span is None else _value(span)
        if value is not None:
            yield value
        at += len(span) if span else 1


def json_of(text: str | None) -> str | None:
    """The first JSON object or list of a text as JSON, from fenced blocks first; null if there is none.

    A text that begins with an object gives a list only if no object is found.
    """
    if text is None:
        return None
    text = text[:MOST_JSON]
    bare = text.strip()
    whole = _FENCE.fullmatch(bare)
    parts = ([whole.group(1)] if whole else []) + _FENCE.findall(text) + [text]
    wants_object = _OPENED.sub("", bare, count=1).startswith("{")
    spare = None
    for value in (v for p in parts for v in _values(p)):
        if not (wants_object and isinstance(value, list)):
            return json.dumps(value, ensure_ascii=False)
        spare = value if spare is None else spare
    return None if spare is None else json.dumps(spare, ensure_ascii=False)


def json_in_prose(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``json``.  Matching brackets outside strings is beyond SQL functions, so Arrow batches go through pandas."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(json_of, na_action="ignore")

    return rows.withColumn("json", found(F.col(text)))
