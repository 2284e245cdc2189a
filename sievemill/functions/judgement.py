"""What judges of a fix write: gates read from JSON, and the text that justifies a verdict; texts with settings in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.status import FIXED, PARTLY

# States of a gate, evidence that is named, and what is advised without a failed gate.
GATE_STATES = ["pass", "partial", "fail", "skip"]
MOST_ANCHORS = 5
ADVICE = "Review all failing gates and apply fixes"

# Settings that hold a secret, and settings that are not safe.
SECRET = (
    r"(?i)(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?key|auth[_-]?token|private[_-]?key|client[_-]?secret|credential)s?[ \t]*[:=][ \t]*['\"]?"
    r"(?!CRYPT:|ENC\(|\{\{|\$\{|<%=|<%|vault:|secret:|file:|/)(?![\w.-]+[ \t]*:)[^\s'\",}{]{8,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bxox[baprs]-[0-9A-Za-z-]{10,}\b|\bgh[pousr]_[0-9A-Za-z]{36,}\b"
    r"|\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
)
UNSAFE = (
    r"(?i)\b(?:verify|verif(?:y|ication)[_-]?ssl|ssl[_-]?verify|validate[_-]?cert\w*|tls[_-]?verify|check[_-]?hostname|reject[_-]?unauthori[sz]ed)\b\s*[:=]\s*['\"]?(?:false|0|no|none|off)\b"
    r"|\binsecure\w*\s*[:=]\s*['\"]?(?:true|1|yes)\b|\bInsecureSkipVerify\s*[:=]\s*true\b"
    r"|\b(?:auth|authentication|authn|security)\s*[:=]\s*['\"]?(?:none|disabled|off|false)\b"
    r"|\bdebug\s*[:=]\s*['\"]?(?:true|1|yes)\b|\ballow[_-]?anonymous\s*[:=]\s*['\"]?(?:true|1|yes)\b"
)


def suspicious(text: Column) -> Column:
    """Distinct settings of a text that hold a secret or are not safe, blanks joined, 80 characters each; null is empty."""
    found = lambda words, name: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(words), F.lit(0)), lambda x: F.concat(F.lit(name), F.substring(F.regexp_replace(x, r"\s+", " "), 1, 80)))
    return F.array_sort(F.array_distinct(F.concat(found(SECRET, "secret:"), found(UNSAFE, "insecure:"))))


def _string(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def gate(entry: Column, name_field: str) -> Column:
    """A gate (name, status, summary, details, evidence) from an object as JSON text; null if the text is none.

    What is no string is empty, a line that is no whole number null, evidence that is no object is left out, and a status
    that is not known ``invalid``.
    """
    v = F.try_parse_json(entry)
    state = F.lower(F.trim(_string(v, "$.status")))
    line = lambda e: F.when(F.schema_of_variant(F.variant_get(e, "$.line", "variant")) == "BIGINT", F.try_variant_get(e, "$.line", "bigint"))
    listed = F.filter(F.try_variant_get(v, "$.evidence", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    evidence = F.transform(listed, lambda e: F.struct(_string(e, "$.file").alias("file"), line(e).alias("line"), _string(e, "$.snippet").alias("snippet")))
    none = F.array().cast("array<struct<file:string,line:bigint,snippet:string>>")
    out = F.struct(_string(v, f"$.{name_field}").alias("name"), F.when(state.isin(*GATE_STATES), state).otherwise("invalid").alias("status"), _string(v, "$.summary").alias("summary"), _string(v, "$.details").alias("details"), F.coalesce(evidence, none).alias("evidence"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), out)


def justification(verdict: Column, score: Column, gates: Column, given: Column) -> Column:
    """The text beside a verdict: what passed, what is missing, how sure, and where; of an unverifiable one what was given."""
    of = lambda *states: F.filter(gates, lambda g: g["status"].isin(*states))
    said = lambda *states: F.array_join(F.transform(of(*states), lambda g: g["summary"]), "; ")
    places = F.flatten(F.transform(gates, lambda g: F.transform(g["evidence"], lambda e: F.concat(e["file"], F.coalesce(F.concat(F.lit(":"), e["line"].cast("string")), F.lit(""))))))
    files = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(of("fail", "partial"), lambda g: F.transform(g["evidence"], lambda e: e["file"]))), lambda f: f != "")))
    named = lambda none: F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise(none)
    sure = F.concat(F.lit("Fix confidence: "), F.rint(score * 100).cast("int").cast("string"), F.lit("%. "))
    todo = F.transform(of("fail"), lambda g: F.concat(F.lit("Address "), g["name"], F.lit(": "), g["summary"]))
    advice = F.when(F.size(todo) > 0, F.array_join(todo, "; ")).otherwise(ADVICE)
    fixed = F.concat(F.lit("Fix verified: "), said("pass"), F.lit(". "), sure, F.lit("Evidence: "), F.array_join(F.slice(places, 1, MOST_ANCHORS), "; "), F.lit("."))
    partly = F.concat(F.lit("Partial fix: "), said("pass"), F.lit(". Gaps: "), said("fail", "partial"), F.lit(". "), sure, F.lit("Files needing fixes: "), named("N/A"), F.lit("."))
    failed = F.concat(F.lit("Fix insufficient: "), said("fail"), F.lit(". Vulnerable pattern remains in "), named("affected files"), F.lit(". "), sure, F.lit("Recommended action: "), advice, F.lit("."))
    return F.when(verdict == "UNVERIFIABLE", F.coalesce(given, F.lit(""))).when(verdict == FIXED, fixed).when(verdict == PARTLY, partly).otherwise(failed)


def expanded(text: Column, values: Column) -> Column:
    """A text with ``${NAME}`` and ``${NAME:-default}`` filled from a map; unset and empty names take the default, else nothing."""
    form = r"\$\{([A-Z_][A-Z0-9_]*)(?::-([^}]*))?\}"
    plain = F.split(text, form, -1)
    every = lambda i: F.regexp_extract_all(text, F.lit(form), F.lit(i))
    filled = F.zip_with(every(1), every(2), lambda name, default: F.coalesce(F.nullif(F.try_element_at(values, name), F.lit("")), default, F.lit("")))
    return F.array_join(F.zip_with(plain, filled, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")


def span(seconds: Column) -> Column:
    """Seconds as ``1h05m``, ``2m09s`` or ``7s``; negative ones are 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), two(rest), F.lit("s"))).otherwise(F.concat(rest.cast("string"), F.lit("s")))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), two(minutes), F.lit("m"))).otherwise(short)
