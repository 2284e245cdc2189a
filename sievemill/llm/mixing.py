"""Mixes sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over its size.
The fractional parts are rounded dependently: two documents are paired, words move from one to the
other in a random direction (with odds that keep each one's expected copies) until one has a whole
number of copies, and the other goes on, longest documents first.  A cell of bounded size leaves one
fractional document at most; cells meet in a reduction tree, and a source's last document is rounded by
itself, so a source's words miss its target by less than one document.

Defined results: null and empty texts have size 0 and are taken 0 words; documents without a source form
one source, the last; repeated rows are rounded each by itself; ties in size go by doc_id; an empty table
gives an empty result; other columns are ignored (or kept by :func:`mix_documents`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, partitions, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents of a cell on average, and cells that a node of the tree joins.
CELL, FAN_IN = 20_000, 64
#: Sources up to which their table is broadcast: a few MB.  More are joined by salted keys.
BROADCAST_SOURCES, SALTS = 50_000, 32
SEED = 11
_WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """source, source_size, docs, target of every source, and how many sources there are.

    Sources are numbered in a distributed sort.  The level at which unsaturated sources stand (words for a
    unit of weight) is found by passes over the sources that send two sums to the driver each.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranged = materialize(sums.repartitionByRange(max(1, partitions(spark) // 4), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    begin, total = {}, 0
    for row in sorted(ranged.groupBy("part").count().collect()):
        begin[row["part"]] = total
        total += row["count"]
    before = F.coalesce(*[F.when(F.col("part") == k, F.lit(v)) for k, v in begin.items()]) if begin else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + before
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = ranged.withColumn("weight", weight)
    cap = F.col("source_size") * most
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, saturated = 0.0, -1
    while words:
        full = cap < F.col("weight") * level
        got = ranked.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(full).alias("n")).first()
        if got["n"] == saturated or not got["weight"]:
            break
        saturated = got["n"] if level else -1
        level = (words * share - got["cap"]) / got["weight"]
    return ranked.select("source", "source_size", "docs", F.least(F.col("weight") * level, cap).alias("target")), total


def _uniform(a: int, b: int, level: int) -> float:
    """A number from 0 to 1 that depends on two documents."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + (level + SEED) * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) / 2**64


def pivot(p: float, size_p: int, q: float, size_q: int, u: float) -> tuple[float, float]:
    """Two fractions after words have moved between them: one is 0 or 1, both expectations and all words stay."""
    up = min((1 - p) * size_p, q * size_q)
    down = min(p * size_p, (1 - q) * size_q)
    moved = up if u * (up + down) < down else -down
    p, q = p + moved / size_p, q - moved / size_q
    return (0.0 if p < _NEAR else 1.0 if p > 1 - _NEAR else p), (0.0 if q < _NEAR else 1.0 if q > 1 - _NEAR else q)


def _round(rows: DataFrame, level: int) -> DataFrame:
    """One level: sweeps each (source, cell) in order; at most one row of a cell keeps a fraction."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None

        def close(out: list, last: bool) -> None:
            if held is not None:
                if last:
                    held["fraction"] = 1.0 if _uniform(held["doc_id"] or 0, held["size"], ~level) < held["fraction"] else 0.0
                out.append(held)

        final = False
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if (row["source"], row["cell"]) != cell:
                    close(out, final)
                    cell, held, final = (row["source"], row["cell"]), None, row["cells"] <= 1
                if not _NEAR <= row["fraction"] <= 1 - _NEAR:
                    row["fraction"] = float(round(row["fraction"]))
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    u = _uniform(held["doc_id"] or 0, row["doc_id"] or 0, level)
                    held["fraction"], row["fraction"] = pivot(held["fraction"], held["size"], row["fraction"], row["size"], u)
                    whole = [x for x in (held, row) if x["fraction"] in (0.0, 1.0)]
                    out += whole
                    held = next((x for x in (held, row) if x["fraction"] not in (0.0, 1.0)), None)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
        if held is not None:
            out = []
            close(out, final)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    order = ["source", "cell", F.desc("size"), "doc_id"]
    return rows.repartition(partitions(rows.sparkSession), "source", "cell").sortWithinPartitions(*order).mapInArrow(run, rows.schema).select(*names)


def copies(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, cell: int = CELL) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of a materialized table of doc_id, source, size."""
    dims, n = targets(sized, weights, share, most)
    dims = materialize(dims.withColumnRenamed("source", "dim_source"))
    match = F.col("source").eqNullSafe(F.col("dim_source"))
    if n <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(dims), match)
    else:
        salted = dims.withColumn("dim_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(salted, match & (F.col("salt") == F.col("dim_salt")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + _NEAR).cast("int")
    fraction = F.when(F.col("size") > 0, F.greatest(expected - whole, F.lit(0.0))).otherwise(0.0)
    cells = F.ceil(F.col("docs") / cell).cast("int")
    rows = joined.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), fraction.alias("fraction"), cells.alias("cells"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), cells).cast("int").alias("cell"))
    widest = dims.agg(F.max(F.ceil(F.col("docs") / cell))).first()[0] or 1
    done = None
    for level in range(1 + max(0, math.ceil(math.log(max(widest, 1)) / math.log(FAN_IN) - 1e-9))):
        if level:
            rows = rows.withColumn("cells", F.ceil(F.col("cells") / FAN_IN).cast("int")).withColumn("cell", F.floor(F.col("cell") / FAN_IN).cast("int"))
        rounded = materialize(_round(rows, level))
        whole_rows = rounded.where(F.col("fraction").isin(0.0, 1.0))
        done = whole_rows if done is None else done.unionByName(whole_rows)
        rows = rounded.where(~F.col("fraction").isin(0.0, 1.0))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("int")).alias("copies"))


def size_table(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return copies(size_table(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it.

    Rows that share doc_id and size share their copies: the first get one more where they don't divide.
    """
    n, total, key, size, nth = fresh(docs, "mix_rows", "mix_copies", "mix_doc", "mix_size", "mix_nth")
    taken = copies(size_table(docs)).groupBy(F.col("doc_id").alias(key), F.col("size").alias(size)).agg(F.count("*").alias(n), F.sum("copies").alias(total))
    joined = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (word_count() == F.col(size)))
    order = F.row_number().over(Window.partitionBy(key, size).orderBy(F.xxhash64(*docs.columns)))
    repeats = F.floor(F.col(total) / F.col(n)) + F.when(F.col(nth) <= F.col(total) % F.col(n), 1).otherwise(0)
    numbered = joined.withColumn(nth, order)
    return numbered.where(repeats > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), repeats.cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
