"""Ordered gates that name the first reason for dropping a row, so that nothing vanishes unaccounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.globs import first_hit

# Paths of tests, endings of native files, classes that the gates take.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|mocks?|examples?|fixtures?|samples?|testdata)(/|$)|_test\.|\.test\.|\.spec\.|Test\.java$|Tests\.cs$"
NATIVE_FILE = r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$"
MEMORY_CLASSES = ["use-after-free", "heap-overflow", "stack-overflow", "format-string", "integer-overflow", "type-confusion"]


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])


def gate_cascade(findings: DataFrame, inventory: DataFrame, classes: list[str] = MEMORY_CLASSES, least: float = 0.6) -> DataFrame:
    """Adds ``reason`` (null: kept).  ``inventory`` has the column ``file``; its keys meet the findings once.

    An empty inventory says nothing, so its gate is open.
    """
    known = inventory.select("file").distinct().withColumn("listed", F.lit(True))
    any_known = known.agg(F.count("*") > 0).scalar()
    in_test = F.col("file").rlike(TEST_PATH)
    rules = [
        ("not native", ~F.col("file").rlike(NATIVE_FILE)),
        ("class not enabled", ~F.col("vuln_class").isin(classes)),
        ("test path", in_test & (F.col("vuln_class") != "info-leak")),
        ("not in inventory", F.col("listed").isNull() & any_known),
        ("low confidence", F.col("confidence") < least),
    ]
    return findings.join(known, "file", "left").withColumn("reason", first_reason(rules)).drop("listed")


def exclusion(files: DataFrame, directories: list[str], extensions: list[str], globs: list[str], most: int) -> DataFrame:
    """Adds ``kind`` and ``key`` of the first rule that excludes a file: directory, extension, glob, size."""
    parts = F.split("path", "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    directory = F.get(F.filter(parents, lambda x: F.lower(x).isin(directories)), 0)
    extension = F.coalesce(*[F.when(F.lower("path").endswith(e), F.lit(e)) for e in extensions])
    glob = first_hit("path", globs)
    size = F.when(F.col("size") > most, F.lit("oversize"))
    kind = F.when(directory.isNotNull(), "directory").when(extension.isNotNull(), "extension").when(glob.isNotNull(), "glob").when(size.isNotNull(), "size")
    return files.withColumn("kind", kind).withColumn("key", F.coalesce(directory, extension, glob, size))


def verdict_split(rows: DataFrame, least: int = 7) -> DataFrame:
    """keep, UNCONFIRMED, VERIFY_ERROR or FALSE_POSITIVE by verdict and confidence (0 to 10)."""
    outcome = F.when((F.col("verdict") == "TP") & (F.col("conf") >= least), "keep").when(F.col("verdict") == "TP", "UNCONFIRMED").when(F.col("verdict").isNull() & (F.col("conf") == 0), "VERIFY_ERROR").otherwise("FALSE_POSITIVE")
    return rows.withColumn("outcome", outcome)


def admit(rows: DataFrame, eligible: Column, limit: int | None, order: list) -> DataFrame:
    """Ineligible rows go first; of the rest the first ``limit`` (None: all) are admitted.

    The budget is one number for all rows: the rank of the last admitted row is found with a top-k, not
    with a window over everything.
    """
    reason = F.when(~eligible, "class not eligible")
    if limit is None:
        return rows.withColumn("reason", reason)
    chosen = rows.where(eligible).orderBy(*order).limit(limit).select(F.col("ord").alias("admitted"))
    met = rows.join(chosen, F.col("ord") == F.col("admitted"), "left")
    return met.withColumn("reason", F.coalesce(reason, F.when(F.col("admitted").isNull(), "budget exhausted"))).drop("admitted")


def policy_decide(rows: DataFrame, deny: dict[str, str], deny_paths: list[str], allow: list[str], default: str = "guidance_only") -> DataFrame:
    """action and rule: unmapped, denied class, sensitive path, allowed class, default - in this order."""
    denied = F.coalesce(*[F.when(F.col("cwe") == c, F.lit(r)) for c, r in deny.items()])
    path = first_hit("path", deny_paths)
    rule = F.when(F.col("cwe").isNull(), "unmapped_cwe").when(denied.isNotNull(), F.concat(F.lit("deny:"), denied)).when(path.isNotNull(), F.concat(F.lit("deny_path:"), path)).when(F.col("cwe").isin(allow), "allow_list").otherwise("default_action")
    action = F.when(rule == "allow_list", "patch").when(rule == "default_action", F.lit(default)).otherwise("guidance_only")
    return rows.withColumn("rule", rule).withColumn("action", action)


def policy_gate(rows: DataFrame, deny: list[tuple[str, str, list[str]]], deny_paths: list[str], allow: list[str], default: str = "guidance_only", killed: str | None = None) -> DataFrame:
    """Adds ``action``, ``reason`` and ``matched`` to rows (cwe, path): the most that a policy allows.

    ``killed`` (``env`` or ``file``) tells that a switch is on, which stops all.  Then, in this order: no weakness, one that
    ``deny`` (weakness, reason, those below it) names or lists below another, a path that a pattern denies, one that is
    allowed, the default.  A weakness of its own entry has that entry's reason, the last one's if there are more, else that
    of the first entry it is below.  The policy is small and known before any row.
    """
    if killed:
        return rows.withColumns({"action": F.lit("guidance_only"), "reason": F.lit(f"kill_switch_{killed}"), "matched": F.lit(None).cast("string")})
    below = {}
    for cwe, why, children in deny:
        for child in children:
            below.setdefault(child, f"descendant_of:{cwe} ({why})")
    reasons = below | {cwe: why for cwe, why, _ in deny}
    denied = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("cwe") == c, F.lit(r)) for c, r in reasons.items()])
    given = rows.withColumn("_path", F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")))
    path = first_hit("_path", deny_paths)
    allowed = F.coalesce(F.col("cwe").isin(allow), F.lit(False))
    reason = F.when(F.col("cwe").isNull(), "unmapped_cwe").when(denied.isNotNull(), denied).when(path.isNotNull(), F.concat(F.lit("sensitive_path:"), path)).when(allowed, "allow_list").otherwise("default_action")
    matched = F.when(F.col("cwe").isNull(), None).when(denied.isNotNull(), F.concat(F.lit("deny:"), "cwe")).when(path.isNotNull(), F.concat(F.lit("deny_path:"), path)).when(allowed, F.concat(F.lit("allow:"), "cwe"))
    out = given.withColumns({"reason": reason, "matched": matched})
    action = F.when(F.col("reason") == "allow_list", "patch").when(F.col("reason") == "default_action", F.lit(default)).otherwise("guidance_only")
    return out.withColumn("action", action).drop("_path")


def cap_per_group(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)
