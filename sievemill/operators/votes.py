"""Votes over runs, representatives and non-transitive collapse of overlapping findings."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quorum(findings: DataFrame, threshold: int = 2, bucket: int = 10) -> DataFrame:
    """Per file, line bucket and class: in how many runs it was found, and its most confident, earliest row.

    One aggregation does both: partial counts and argmax are combined before the shuffle.
    """
    key = ["file", F.floor(F.col("line_start") / bucket).cast("long").alias("bucket"), "vuln_class"]
    best = F.min_by(F.struct("ord", "line_start", "line_end", "confidence"), F.struct(-F.col("confidence"), F.col("ord")))
    voted = findings.groupBy(*key).agg(F.size(F.collect_set("run")).cast("long").alias("votes"), best.alias("best"))
    return voted.where(F.col("votes") >= threshold).select("file", "bucket", "vuln_class", "votes", "best.*")


def collapse_overlaps(findings: DataFrame, tolerance: int = 3) -> DataFrame:
    """(file, vuln_class, ord, root): the earliest survivor of the same file and class that a row overlaps or starts near,
    else its own ord.

    Greedy in order of ``ord`` and only against survivors, hence not transitive.  Rows pass by once, in order; only the
    survivors of one file and class are held, by their first lines: as they don't overlap, those that a row meets stand
    side by side.  Rows without lines survive and meet none.
    """
    rows = findings.select("file", "vuln_class", "ord", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))
    schema = T.StructType([rows.schema[c] for c in ("file", "vuln_class", "ord")] + [T.StructField("root", rows.schema["ord"].dataType)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, turned = None, [], False
        for batch in batches:
            roots = []
            for file, kind, ord_, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (file, kind):
                    group, kept, turned = (file, kind), [], False
                root = ord_
                if first is not None and last is not None:
                    lo, hi = 0, len(kept)
                    if not turned and first <= last:
                        lo = bisect.bisect_left(kept, (first - tolerance,))
                        while lo and kept[lo - 1][1] >= first:
                            lo -= 1
                        hi = bisect.bisect_right(kept, (max(last, first + tolerance) + 1,))
                    met = [o for s, e, o in kept[lo:hi] if abs(s - first) <= tolerance or (s <= last and first <= e)]
                    if met:
                        root = min(met)
                    else:
                        # lines the wrong way round may stand anywhere: from then on all survivors are looked at
                        turned = turned or first > last
                        bisect.insort(kept, (first, last, ord_))
                roots.append(root)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, batch.schema.field("ord").type)], ["file", "vuln_class", "ord", "root"])

    return rows.repartition("file", "vuln_class").sortWithinPartitions("file", "vuln_class", "ord", "line_start", "line_end").mapInArrow(walk, schema)
