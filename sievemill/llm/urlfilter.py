"""Judges urls by host and path rules held as a sorted array of 64-bit digests.

A rule's key is the xxhash of its text (host and path).  The keys are sorted in one array that executors
map from a file; the rules' full texts and verdicts stand beside it.  A url is probed with every suffix
of its host and, for each length that rule paths have, the start of its path; all probes of a batch are
one vectorised binary search, and every hit is confirmed against the stored text.  The longest rule wins
(of two that are as long, the one with the longer host); a url without a rule is allowed.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, verdict allow;
repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

#: Host and path of each rule, and its verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Bytes of rules up to which they are sent to every executor.  A larger list is joined by key.
BROADCAST_BYTES = 64 << 20
NO_RULE = "allow"


@dataclass
class RuleSet:
    """Rules in the order of their digests."""

    keys: np.ndarray
    texts: list[str]
    hosts: list[int]
    verdicts: list[str]
    lengths: list[int]

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> RuleSet:
        """Of rules with the same host and path the last one holds."""
        last = {(host.lower(), path): verdict for host, path, verdict in rules}
        rows = sorted((xxhash.xxh64_intdigest((h + p).encode("utf-8", "surrogatepass")), h + p, len(h), v) for (h, p), v in last.items())
        return cls(np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], sorted({len(p) for _, p in last}))

    def bytes(self) -> int:
        return self.keys.nbytes + sum(len(t) + 24 for t in self.texts)

    def mapped(self) -> np.ndarray:
        """The keys, mapped from a file of this process's temporary folder."""
        handle, name = tempfile.mkstemp(suffix=".keys")
        with os.fdopen(handle, "wb") as f:
            self.keys.tofile(f)
        try:
            return np.memmap(name, np.uint64, "r") if len(self.keys) else self.keys
        finally:
            os.unlink(name)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_ASCII_LOWER), path


def probes(host: str, path: str, lengths: list[int]) -> list[tuple[str, int]]:
    """Text and host length of every rule that could fit, a longer host first."""
    out = []
    while host:
        out += [(host + path[:n], len(host)) for n in reversed(lengths) if n <= len(path)]
        dot = host.find(".")
        host = host[dot + 1 :] if dot >= 0 else ""
    return out


class Prober:
    _own: dict[int, Prober] = {}

    def __init__(self, rules: RuleSet):
        self.rules, self.keys = rules, rules.mapped()

    @classmethod
    def of(cls, rules: RuleSet) -> Prober:
        if id(rules) not in cls._own:
            cls._own.clear()
            cls._own[id(rules)] = cls(rules)
        return cls._own[id(rules)]

    def __call__(self, parts: list[tuple[str, str]]) -> list[int]:
        """Place of each url's rule, or -1."""
        rules, best = self.rules, [-1] * len(parts)
        tries, owner = [], []
        for i, (host, path) in enumerate(parts):
            found = probes(host, path, rules.lengths)
            tries += found
            owner += [i] * len(found)
        if not tries or not len(self.keys):
            return best
        digest = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in tries), np.uint64, len(tries))
        at = np.searchsorted(self.keys, digest)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digest):
            j, (text, host) = int(at[k]), tries[k]
            while j < len(self.keys) and self.keys[j] == digest[k]:
                if rules.texts[j] == text and rules.hosts[j] == host:
                    old = best[owner[k]]
                    if old < 0 or (len(text), host) > (len(rules.texts[old]), rules.hosts[old]):
                        best[owner[k]] = j
                j += 1
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    held = RuleSet.of(rules)
    if held.bytes() > BROADCAST_BYTES:
        return judge_by_join(pages, rules)
    sent = pages.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rules = sent.value
        parts = [split_url(u) for u in batch.column("url").to_pylist()]
        found = Prober.of(rules)(parts)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([rules.texts[j] if j >= 0 else None for j in found], pa.string()), pa.array([rules.verdicts[j] if j >= 0 else NO_RULE for j in found], pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    return map_slices(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), run, "page_id long, host string, path string, rule string, verdict string", "url")


def judge_by_join(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """The same for rule lists of any size: probes and rules meet by key in a shuffle."""
    spark = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(h.lower(), p, v) for h, p, v in {(h.lower(), p): (h, p, v) for h, p, v in rules}.values()], "rule_host string, rule_path string, rule_verdict string")
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, page, url in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url")), strict=True):
            host, path = split_url(url)
            out.append((row, page, host, path, None, None))
            out += [(row, page, host, path, t[:n], t[n:]) for t, n in probes(host, path, lengths)]
        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "page_id", "host", "path", "try_host", "try_path"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url")
    tries = map_slices(rows, explode, "row long, page_id long, host string, path string, try_host string, try_path string", "url")
    met = tries.join(listed, (F.col("try_host") == F.col("rule_host")) & (F.col("try_path") == F.col("rule_path")), "left")
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.coalesce(F.length(rule), F.lit(-1)).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(NO_RULE)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM rest),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
