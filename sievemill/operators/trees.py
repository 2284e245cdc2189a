"""Masking of sensitive values in nested rows: strings change, wherever they stand, and nothing else does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions import redact


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    return isinstance(kind, T.StructType) and any(_holds_text(f.dataType) for f in kind)


def leaves(value: Column, kind: T.DataType) -> Column:
    """All strings of a value, as one array; keys of maps are none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(value.cast("string"))
    if not _holds_text(kind):
        return none
    if isinstance(kind, T.StructType):
        return F.coalesce(F.concat(none, *[leaves(value.getField(f.name), f.dataType) for f in kind if _holds_text(f.dataType)]), none)
    inside, items = (kind.valueType, F.map_values(value)) if isinstance(kind, T.MapType) else (kind.elementType, value)
    return F.coalesce(F.flatten(F.transform(items, lambda x: leaves(x, inside))), none)


def rebuilt(value: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """The value with ``change`` of each of its strings; its type stays."""
    if isinstance(kind, T.StringType):
        return change(value)
    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StructType):
        made = F.struct(*[rebuilt(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rebuilt(x, kind.valueType, change))
    return F.transform(value, lambda x: rebuilt(x, kind.elementType, change))


def masked(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the strings in ``columns``, of any type, as :func:`redact.redact` masks them.

    Structs, arrays and values of maps are gone into; keys of maps, other columns and all types stay; null stays null.
    ``key`` is unique and not null.  Each different string is masked once, whatever holds it; only rows with one that
    changes get a small table of what becomes what.  Strings inside variants are not looked into.
    """
    kinds = {c: rows.schema[c].dataType for c in columns}
    found = rows.select(key, F.explode(F.array_distinct(F.concat(*[leaves(F.col(c), k) for c, k in kinds.items()]))).alias("_leaf")).where("_leaf != ''")
    # the condition looks at the count, too: one on the string alone would be tested on each row, before strings are made one
    each = found.groupBy("_leaf").agg(F.count("*").alias("_n"))
    changed = redact.redact(each, "_leaf").where(F.when(F.col("_n") > 0, F.col("redacted") != F.col("_leaf"))).select("_leaf", "redacted")
    tables = found.join(changed, "_leaf").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_leaf", "redacted"))).alias("_table"))
    met = rows.join(tables, key, "left")
    swap = lambda x: F.coalesce(F.try_element_at(F.col("_table"), x), x)
    out = [F.when(F.col("_table").isNull(), F.col(c)).otherwise(rebuilt(F.col(c), kinds[c], swap)).alias(c) if c in kinds else F.col(c) for c in rows.columns]
    return met.select(*out)
