"""How the sources of a language differ in their words: exact counts of the terms that a merged sketch lets through.

Every task counts in how many documents it meets each term of a language and adds these numbers to a count-min
sketch; sketches are merged block by block.  A sketch never underestimates, so a term whose smallest counter stays
below ``min_docs`` can't be in enough documents and is dropped in the task that meets it, before anything about it
is shuffled.  The other terms are counted exactly.  Sources are compared by sparse joins: terms that neither of two
sources has add the same share each, terms that one has are summed by how often it has them, and only terms of both
are joined.  All arithmetic is in whole numbers.

Defined results: null text, language and source are the empty string; texts without a term, or of any length, count
whole; every (language, source) that occurs takes part, also without terms; repeated rows are documents of their own;
equal values are ranked by item, in the order of their UTF-8 bytes; a language with no kept term has value 0 for all
pairs; a language with one source has no pairs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, partitions, slices, table

MIN_DOCS, TOP = 10, 10
#: Counters of a row of the sketch, rows, and counters of a block: the sketch takes 64 MB in a task, its answer 2 MB everywhere.
WIDTH, DEPTH, BLOCK = 1 << 22, 4, 1 << 14
#: Different terms of sources that a task holds before it hands them on.
HELD = 900_000
#: Bytes that are part of a term stay, A-Z in lower case; all others separate.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def places(lang: str, words: list[bytes], width: int, depth: int) -> np.ndarray:
    """The counter of each term in each row of the sketch."""
    seed = zlib.crc32(lang.encode())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(r) * step) & np.uint64(width - 1)).astype(np.int64) for r in range(depth)])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    for part in slices(batch, "text"):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            yield lang, source, terms(text)


def possible(docs: DataFrame, min_docs: int, width: int, depth: int) -> np.ndarray:
    """For each counter of the merged sketch whether it reaches ``min_docs``, as bits."""
    block = min(BLOCK, width)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, found = np.zeros((depth, width), np.uint32), defaultdict(Counter)

        def put() -> None:
            for lang, count in found.items():
                n = np.fromiter(count.values(), np.uint32, len(count))
                for row, place in enumerate(places(lang, list(count), width, depth)):
                    np.add.at(sketch[row], place, n)
            found.clear()

        for batch in batches:
            for lang, _, words in _read(batch):
                found[lang].update(set(words))
            if sum(map(len, found.values())) > HELD:
                put()
        put()
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = sketch.reshape(-1, block)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([squeeze.compress(parts[i].tobytes())])], ["block", "counters"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, at, total = zstandard.ZstdDecompressor(), None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(total >= min_docs).tobytes()])], ["block", "reached"])

        for batch in batches:
            for i, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                counters = np.frombuffer(unpack.decompress(data), np.uint32)
                if i == at:
                    total += counters
                    continue
                if at is not None:
                    yield done()
                at, total = i, counters.astype(np.uint64)
        if at is not None:
            yield done()

    filled = map_arrow(docs, fill, "block long, counters binary")
    merged = map_arrow(filled.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block"), merge, "block long, reached binary")
    out = np.zeros((depth * width // block, block // 8), np.uint8)
    # one bit for a counter: bounded by width and depth, whatever the input
    for row in merged.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["reached"], np.uint8)
    return out.reshape(depth, width // 8)


_COUNTS = "lang string, term string, counts array<struct<source: string, n: long>>"


def _counts(lang: str, live: dict[bytes, int], words_of: dict[str, Counter]) -> pa.RecordBatch:
    """A row for each live term (documents by term) with its counts in each source, and one without a term for all sources."""
    index = {w: i for i, w in enumerate(live)}
    every, term, code, n = sorted(words_of), [np.arange(len(live))], [np.full(len(live), len(words_of))], [np.fromiter(live.values(), np.int64, len(live))]
    for k, source in enumerate(every):
        found = words_of[source]
        kept = index.keys() & found.keys()
        term.append(np.fromiter(map(index.__getitem__, kept), np.int64, len(kept)))
        n.append(np.fromiter(map(found.__getitem__, kept), np.int64, len(kept)))
        code.append(np.full(len(kept), k))
    # the row without a term comes last
    term.append(np.full(len(every), len(live)))
    code.append(np.arange(len(every)))
    n.append(np.zeros(len(every), np.int64))
    at = np.concatenate(term)
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(live) + 1))])
    pair = pa.StructArray.from_arrays([pa.array([*every, None], pa.string()).take(pa.array(np.concatenate(code)[order])), pa.array(np.concatenate(n)[order])], ["source", "n"])
    many = len(live) + 1
    return pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.array([*live, None], pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)], ["lang", "term", "counts"])


def counted(docs: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, term, source, n for every term that may be in enough documents of its language: occurrences in each source,
    and in a row without a source the language's documents; a row without a term for every (lang, source).

    A task hands on one row for each term, with all its sources; they are dealt by term, and stay there for the sums.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    reached = possible(docs, min_docs, width, depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, docs_of = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)

        def put() -> Iterator[pa.RecordBatch]:
            for lang, d in docs_of.items():
                words = list(d)
                ok = np.ones(len(words), bool)
                for row, at in enumerate(places(lang, words, width, depth)):
                    ok &= (reached[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield _counts(lang, {w: d[w] for w, k in zip(words, ok.tolist(), strict=True) if k}, words_of[lang])
            words_of.clear()
            docs_of.clear()

        for batch in batches:
            for lang, source, words in _read(batch):
                words_of[lang][source].update(words)
                docs_of[lang].update(set(words))
            if sum(len(n) for of in words_of.values() for n in of.values()) > HELD:
                yield from put()
        yield from put()

    dealt = map_arrow(docs, count, _COUNTS).repartition(partitions(docs.sparkSession), "lang", "term")
    return dealt.select("lang", "term", F.inline("counts")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, size: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 size)), exact for counts of any size."""
    return F.expr(f"cast(1 + (cast(1000000000 as decimal(10, 0)) * ({n} + 2)) div ({total} + 2 * {size}) as long)")


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so that the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources (``pair``) and the ``top`` terms (``term``) of each source."""
    rows = materialize(counted(docs, min_docs, width, depth))
    of = F.when(F.col("source").isNull(), F.col("n"))
    by_term = rows.where("term is not null").groupBy("lang", "term").agg(F.sum(of).alias("docs"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("n")).where(F.col("docs") >= min_docs)
    kept = materialize(by_term.select("lang", "term", F.col("n").alias("lang_n")))
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    found = rows.where("source is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = rows.where("source is not null").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "own", "size", "lang_total")])
    # of a language without kept terms no share is needed
    groups = materialize(groups.withColumn("none", F.when(F.col("size") > 0, _share("0", "total", "size"))))
    shares = materialize(found.join(groups, ["lang", "source"]).select("lang", "source", "term", "none", _share("n", "total", "size").alias("p"), _share("lang_n", "lang_total", "size").alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    tops = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    tops = tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # terms that both of two sources have, each pair of sources once
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("zb"))
    change = F.expr(f"{_apart('pa', 'pb')} - {_apart('pa', 'zb')} - {_apart('za', 'pb')}")
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("change"), F.count("*").alias("common"))
    # terms that the first has, if the second had none of them
    levels = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    others = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("zb"))
    alone = levels.join(others, "lang").where("a != b").groupBy("lang", "a", "b").agg(F.expr(f"sum(k * {_apart('p', 'zb')})").alias("alone"))

    one = groups.select("lang", F.col("source").alias("a"), F.col("own").alias("na"), F.col("none").alias("za"), "size")
    two = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("nb"), F.col("none").alias("zb"))
    pairs = one.join(two, "lang").where("a < b").join(both, ["lang", "a", "b"], "left")
    for x, y, name in (("a", "b", "ab"), ("b", "a", "ba")):
        pairs = pairs.join(alone.select("lang", F.col("a").alias(x), F.col("b").alias(y), F.col("alone").alias(name)), ["lang", "a", "b"], "left")
    rest = f"coalesce(ab, 0) + coalesce(ba, 0) + coalesce(change, 0) + (size - na - nb + coalesce(common, 0)) * {_apart('za', 'zb')}"
    pairs = pairs.select("lang", "a", "b", F.expr(f"case when size = 0 then 0 else {rest} end").cast("long").alias("value"))
    turned = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", turned.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(tops)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_P = "CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 2)) // ({total} + 2 * size) AS HUGEINT)"
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS size, sum(lang_n) AS lang_total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
p AS (SELECT m.lang, m.source, m.term, m.n, {_P.format(n='m.n', total='t.total')} AS p, {_P.format(n='m.lang_n', total='l.lang_total')} AS q FROM m JOIN t ON t.lang = m.lang AND t.source = m.source JOIN l ON l.lang = m.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
