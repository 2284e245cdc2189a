"""What commands and paths tell: logs of a real crash, arguments without secrets, paths that leave their root, slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of a crash report, the exit code, flags that bear secrets, and classes that are tried.
CRASH = r"(?im)^(?:==\d+==)?(?:ERROR: AddressSanitizer:|AddressSanitizer:DEADLYSIGNAL)"
SUMMARY = r"(?im)^SUMMARY: AddressSanitizer:"
EXIT_CODE = r"(?m)^\[rc=(-?\d+)\]$"
SECRET_FLAG = r"(?i)(token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|client[_-]?secret|auth|credential|bearer|private[_-]?key)"
TRIED = ["use-after-free", "heap-overflow", "stack-overflow", "format-string", "integer-overflow", "type-confusion"]


def real_crash(log: Column) -> Column:
    """Whether a log is of a run command that ended with a code and both records of a crash; null is none."""
    code = F.regexp_extract(log, EXIT_CODE, 1)
    failed = (code != "") & ~code.rlike(r"^-?0+$")
    return F.coalesce(log.startswith("$ ") & failed & log.rlike(CRASH) & log.rlike(SUMMARY), F.lit(False))


def crash_command(logs: Column) -> Column:
    """The command of the first log of a real crash, else empty."""
    first = F.get(F.filter(logs, real_crash), F.lit(0))
    return F.coalesce(F.trim(F.regexp_extract(first, r"^\$ ([^\r\n]*)", 1)), F.lit(""))


def tried(kind: Column, enabled: Column, every: Column, classes: Column) -> Column:
    """Whether a finding is run: if enabled, of all classes, or of those listed; of the usual ones if none are."""
    listed = F.when(F.size(classes) > 0, F.array_contains(classes, kind)).otherwise(kind.isin(*TRIED))
    return F.coalesce(enabled, F.lit(False)) & (F.coalesce(every, F.lit(False)) | F.coalesce(listed, F.lit(False)))


def without_secrets(argv: Column) -> Column:
    """Arguments with ``***`` for what a secret-like flag holds, after ``=`` or as the next one that is no flag."""
    inline = lambda a: a.startswith("-") & F.regexp_extract(a, "^([^=]*)=.+", 1).rlike(SECRET_FLAG)

    def masked(a: Column, i: Column) -> Column:
        before = F.get(argv, i - 1)
        held = F.coalesce(before.startswith("-") & before.rlike(SECRET_FLAG) & ~inline(before), F.lit(False))
        return F.when(held & ~a.startswith("-"), "***").when(inline(a), F.concat(F.substring_index(a, "=", 1), F.lit("=***"))).otherwise(a)

    return F.transform(argv, masked)


def network_path(path: Column) -> Column:
    """Whether a path names another host."""
    return F.coalesce(path.rlike(r"^\s*[\\/]{2}"), F.lit(False))


def within(path: Column, root: str) -> Column:
    """The path below ``root`` (absolute) after ``.`` and ``..`` are worked out; null if it leaves it. Links are not followed."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    kept = F.filter(F.split(full, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    parts = F.aggregate(kept, none, lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
    plain = F.concat(F.lit("/"), F.array_join(parts, "/"))
    base = root.rstrip("/")
    return F.when((plain == base) | plain.startswith(base + "/"), plain)


def numbered(text: Column, offset: Column, limit: Column, most: int = 200_000) -> Column:
    """Lines ``offset`` + 1 on, ``limit`` at most and one at least, as ``number, tab, line``; cut beyond ``most`` characters."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    start = F.greatest(offset.cast("int"), F.lit(0))
    cut = F.slice(lines, start + 1, F.greatest(limit.cast("int"), F.lit(1)))
    body = F.array_join(F.transform(cut, lambda x, i: F.concat((start + i + 1).cast("string"), F.lit("\t"), x)), "\n")
    none = (F.coalesce(text, F.lit("")) == "") | (F.size(cut) == 0)
    return F.when(none, "(file is empty or offset past EOF)").when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n... [truncated]"))).otherwise(body)
