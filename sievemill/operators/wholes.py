"""Texts that are put together from many rows: their parts pass by in order, and no text is held whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class _Whole:
    """Length in code points and SHA-256 of a text that arrives in parts; with ``cut`` without a line end at its end."""

    def __init__(self, cut: bool):
        self.hash, self.size, self.cut, self.owed = hashlib.sha256(), 0, cut, ""

    def add(self, text: str) -> None:
        if not text:
            return
        text, self.owed = self.owed + text, ""
        if self.cut and text.endswith("\n"):
            text, self.owed = text[:-1], "\n"
        self.size += len(text)
        self.hash.update(text.encode("utf-8", "surrogatepass"))


def digests(parts: DataFrame, key: str, between: dict[int, str] | None = None, cut: bool = False) -> DataFrame:
    """(key, size, digest): length and SHA-256 of each key's text, from ``parts`` (key, step, place, part).

    Parts follow each other by step, then place; ``between`` gives what stands between two parts of the same step.  With
    ``cut`` a line end at the end of the text is left out.  Null parts are passed over.  A text's parts are sorted by
    Spark and hashed one after the other, so a task holds one batch of them, however long the text is.
    """
    glue = between or {}
    rows = parts.select(key, "step", "place", "part").where("part is not null").repartition(key).sortWithinPartitions(key, "step", "place")
    schema = T.StructType([parts.schema[key], T.StructField("size", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, at = None, None, None
        for batch in batches:
            out = []
            for k, step, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if whole is None or k != now:
                    if whole is not None:
                        out.append((now, whole))
                    now, whole, at = k, _Whole(cut), None
                if step == at and step in glue:
                    whole.add(glue[step])
                whole.add(text)
                at = step
            yield from _told(out, batch.schema.field(0))
        if whole is not None:
            yield from _told([(now, whole)], batch.schema.field(0))

    def _told(done: list, field: pa.Field) -> Iterator[pa.RecordBatch]:
        if done:
            columns = [pa.array([k for k, _ in done], field.type), pa.array([w.size for _, w in done], pa.int64()), pa.array([w.hash.hexdigest() for _, w in done])]
            yield pa.RecordBatch.from_arrays(columns, [key, "size", "digest"])

    return rows.mapInArrow(run, schema)
