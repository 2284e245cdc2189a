"""Fingerprints of whole texts from closed syncmers.

A k-mer of code points is a closed syncmer if, of its inner s-mers, one with the smallest hash stands at
its start or end: that depends on the k-mer alone, so equal stretches of two texts choose equal anchors.
A fingerprint holds the anchors with the smallest hashes and where they stand; two fingerprints are
likened by their common anchors, counting those that agree on the shift between the texts.

Defined results: a null text is empty; an empty text has an empty fingerprint, alike with its own kind
(1) and with nothing else (0); a text shorter than a k-mer is anchored at
all its stretches of three code points; texts follow each other by
descending doc_id, rows without one last, rows with the same one by text; the last is followed by the
first (a single row by itself); repeated rows stay; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, partitions, table

K, S = 16, 6
#: Texts shorter than K are anchored at all stretches of so many code points.
SHORT = 3
#: Anchors of a fingerprint at most, and code points by which shifts of common anchors may differ.
ANCHORS, SLACK = 96, 64
#: Boundaries are kept in lists of this length, so that a row's bucket is found with two short scans.
_FAN = 64
_LEAST = -(2**63)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M3
    return x ^ (x >> np.uint64(29))


def _gram_hash(points: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(points) - n + 1, 0), np.uint64)
    for i in range(n):
        out *= _M1
        out += points[i : i + len(out)]
    return _mix(out)


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: hashes (32 bits, ascending, distinct) and first places of its anchors."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(sizes) - sizes
    empty = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    out = [empty] * len(texts)
    if len(points) >= K:
        inner = _gram_hash(points, S)
        least = _window_min(inner, K - S + 1)
        closed = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
        owner = np.searchsorted(begin, closed, "right") - 1
        # of empty texts at the same place the last one is found, which has no anchors to lose
        inside = closed + K <= begin[owner] + sizes[owner]
        closed, owner = closed[inside], owner[inside]
        hashed = np.zeros(len(closed), np.uint64)
        for i in range(K):
            hashed *= _M2
            hashed += points[closed + i]
        hashed = (_mix(hashed) >> np.uint64(32)).astype(np.uint64)
        key = (owner.astype(np.uint64) << np.uint64(32)) | hashed
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        key, place = key[first], closed[order][first]
        text = (key >> np.uint64(32)).astype(np.int64)
        starts = np.searchsorted(text, np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(starts)):
            lo, hi = starts[i], min(starts[i] + ANCHORS, starts[i + 1])
            out[i] = ((key[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32), place[lo:hi] - begin[i])
    for i in np.flatnonzero((sizes > 0) & (sizes < K)):
        own = points[begin[i] : begin[i] + sizes[i]]
        hashed, place = np.unique((_gram_hash(own, min(SHORT, len(own))) >> np.uint64(32)).astype(np.uint32), return_index=True)
        out[i] = (hashed, place.astype(np.int64))
    for i, (h, _) in enumerate(out):
        if sizes[i] and not len(h):  # no closed syncmer is impossible for K > S, but a text must have an anchor
            out[i] = (np.array([0], np.uint32), np.zeros(1, np.int64))
    return out


def write(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Anchors as text: eight hex digits of the hash, then the place in hex."""
    return ",".join(f"{h:08x}{p:x}" for h, p in zip(found[0].tolist(), found[1].tolist(), strict=True))


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = text.split(",") if text else []
    return np.array([int(x[:8], 16) for x in parts], np.uint32), np.array([int(x[8:], 16) for x in parts], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of common anchors that agree on a shift, of the smallest anchors of both; 0 to 1."""
    n, m = len(a[0]), len(b[0])
    if not n or not m:
        return float(n == m)
    if n == m and np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    # only below the largest hash of a full fingerprint is it known what the text lacks
    bound = min(a[0][-1] if n >= ANCHORS else 0xFFFFFFFF, b[0][-1] if m >= ANCHORS else 0xFFFFFFFF)
    i = np.minimum(np.searchsorted(b[0], a[0]), m - 1)
    common = (b[0][i] == a[0]) & (a[0] <= bound)
    count = int(common.sum())
    union = int((a[0] <= bound).sum() + (b[0] <= bound).sum()) - count
    if not count:
        return 0.0
    shift = np.sort(a[1][common] - b[1][i[common]])
    agree = int((np.searchsorted(shift, shift + SLACK, "right") - np.arange(count)).max())
    return agree / union


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in buckets of neighbouring ids, with the row that follows each bucket's last."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / (2 * n) for i in range(1, 2 * n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # bucket 0 is the first in the order: the largest ids; a bucket's ids are under the boundary before it
    lists = [cuts[i : i + _FAN] for i in range(0, len(cuts), _FAN)]
    if lists:
        heads = F.lit([x[0] for x in lists])
        page = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
        inside = F.size(F.filter(F.element_at(F.array(*[F.lit(x) for x in lists]), page), lambda x: x <= F.col("doc_id")))
        upper = F.when(page > 0, (page - 1) * _FAN + inside).otherwise(F.lit(0))
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - upper)
    else:
        bucket = F.lit(0)
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    known = F.coalesce("doc_id", F.lit(_LEAST))
    tops = {r["bucket"]: r["top"] for r in dealt.groupBy("bucket").agg(F.max(known).alias("top")).collect()}
    order = sorted(tops)
    # the first rows of a bucket also go to the end of the one before it; those of the first to the last
    goes = {b: order[i - 1] for i, b in enumerate(order)}
    per_bucket = lambda of, lack: F.element_at(F.lit([of.get(b, lack) for b in range(len(cuts) + 1)]), F.col("bucket") + 1)
    also = F.when(known == per_bucket(tops, _LEAST).cast("long"), per_bucket(goes, 0).cast("int"))
    both = F.array_compact(F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("guest")), F.when(also.isNotNull(), F.struct(also.alias("to"), F.lit(1).alias("guest")))))
    spread = dealt.withColumn("at", F.explode(both)).select("doc_id", "text", F.col("at.to").alias("bucket"), F.col("at.guest").alias("guest"))
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _judge(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    # each text is mostly the one that follows its predecessor, and so is anchored once
    index: dict[str, int] = {}
    place = [index.setdefault(t, len(index)) for t in [*texts, *following]]
    own, changed = anchors(list(index)), anchors(edited)
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], [write(own[p]) for p in place[:n]], [write(x) for x in changed]]
    columns.append([likeness(own[p], x) for p, x in zip(place[:n], changed, strict=True)])
    columns.append([likeness(own[p], own[q]) for p, q in zip(place[:n], place[n:], strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def fingerprint(docs: DataFrame) -> DataFrame:
    """A row for every document; see the names in ``_NAMES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, following, size = [], [], [], 0
        held = None
        for bucket, guest, doc, text in _rows(batches):
            if held is not None and held[0] == bucket:
                ids.append(held[1])
                texts.append(held[2])
                following.append(text)
                size += len(text)
                held = None
            if not guest:
                held = (bucket, doc, text)
            if size > SLICE_BYTES // 4:
                yield _judge(ids, texts, following)
                ids, texts, following, size = [], [], [], 0
        if ids:
            yield _judge(ids, texts, following)

    return _with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
