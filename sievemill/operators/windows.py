"""Tiles, merged intervals and capacity packing over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tiles(files: DataFrame, width: int = 600, step: int = 500) -> DataFrame:
    """(path, lo, hi) windows over each file's lines; an empty file has one empty tile."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("lines"), F.lit(1)) - 1, F.lit(step).cast("long")))
    return files.select("path", "lines", starts.alias("lo")).select("path", "lo", F.least(F.col("lo") + width, "lines").alias("hi"))


def merge_intervals(anchors: DataFrame, around: int = 300, gap: int = 100) -> DataFrame:
    """(file, lo, hi) of the windows around anchors, joined where the next begins within ``gap`` of an end.

    Lines count from 0; a window stays within the file's ``lines``.
    """
    spans = anchors.select("file", F.greatest(F.col("line") - around, F.lit(0)).alias("lo"), F.least(F.col("line") + around, F.col("lines")).alias("hi"))
    w = Window.partitionBy("file").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(True))
    islands = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("file", "lo", "hi")


def pack_in_order(items: DataFrame, group: str, capacity: int, most: int) -> DataFrame:
    """(group, ord, shard): items in order of ``ord`` start a new shard (from 1) when size or count would exceed its bound.

    The first item of a shard may be larger than ``capacity``; a null size is 0.  A group's items pass by once, in
    order, and nothing of them is held: where a shard begins depends on all before it.
    """
    rows = items.select(group, "ord", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")).repartition(group).sortWithinPartitions(group, "ord", "size")
    schema = T.StructType([items.schema[group], items.schema["ord"], T.StructField("shard", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard, size, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard == 0 or key != last:
                    last, shard, size, n = key, 1, x, 1
                elif n < most and size + x <= capacity:
                    size, n = size + x, n + 1
                else:
                    shard, size, n = shard + 1, x, 1
                out.append(shard)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [group, "ord", "shard"])

    return rows.mapInArrow(walk, schema)


def retain(rows: DataFrame, group: str, newest: int, oldest) -> DataFrame:
    """Rows to remove: older than ``oldest`` or not among the ``newest`` of their group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("updated_at"), "ord"))
    return rows.withColumn("rank", rank).where((F.col("rank") > newest) | (F.col("updated_at") < oldest))
