"""Near-duplicate documents: Jaccard join of word n-gram sets by a grouped prefix join.

1. Documents with the same set of shingles are one class (a 128-bit digest); classes carry on.
2. Shingles are ordered by how common they are (a counting sketch of fixed size over all documents,
   then their hash).  Any order that all documents share keeps the join exact; where the sketch is full,
   only the commonest shingles are told apart, which steps 3 and 4 bear.
3. A set's prefix are its first ``L + l - 1`` shingles, where ``L = n - ceil(t * n) + 1`` and ``l`` is L or, if
   less, ``ceil(t * n)``.  Two sets as similar as asked for have the lesser ``l`` of both in common within their
   prefixes, and one at least within the first ``L``.  Classes with the same prefix and size are collapsed into
   one group.  A group stays if so many of its prefix shingles as its least similar partner must have in common
   with it stand in another group's prefix too, or if it has several members.
4. Group pairs: first each list of the first ``L`` shingles pairs its heaviest group with the others, so that
   clusters become connected with few pairs; then groups of different components meet wherever they share
   a list.  Pairs are filtered by size, by position and by the number of common prefix shingles.
5. What is left is expanded to members: a representative of one group against all of the other, and members
   against members only where components still differ.  They are verified on the full sets; pairs within a
   component would add no connection.
6. Verified links are joined into components by hooking and pointer jumping.

Defined results: a text with fewer than n words is one shingle, all its words; null and wordless texts
have an empty set and link with nothing; texts of any length count whole; repeated rows link with each other;
a component's id is its smallest doc_id; rows without a doc_id get the id of what they link with, else null;
an empty table gives an empty result; other columns are ignored (or kept by :func:`keep_one`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, map_arrow, materialize, partitions, slices, table

#: Near-duplicate stages take five words and a similarity of 0.8.
WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Counters of the sketch of common shingles and of a block of it; the sketch is what is broadcast (bytes).
CELLS, CELL_BLOCK = 1 << 20, 1 << 15
#: Least and most bits of the filter that finds classes to verify, by their number.  It only spares work: what
#: passes is joined exactly.
FILTER_BITS = 1 << 20, 1 << 27
#: Places of a list that are held at a time; longer lists are dealt into blocks that meet two by two.
LIST_ROWS = 20_000
#: Long lists up to which their table, of two numbers each, is broadcast.
BROADCAST_LISTS = 100_000
#: Texts are taken up to 2^OWNER_BITS at a time; a shingle's hash has the other bits of 64, so that two
#: different shingles of a pair of documents fall together about once in 10^11 pairs.
OWNER_BITS = 10
#: Bytes of a shingle's hash that are compared: two sets of 500 differ by chance once in 10^9 pairs.
SET_BYTES = 6
_HASH = np.uint64((1 << (64 - OWNER_BITS)) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[2]
    x = (x ^ (x >> np.uint64(27))) * _M[3]
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M[0])
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(_M[4]), -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < 2 * n:
        up, down = np.full(n, _M[4]), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _POWERS = np.concatenate([np.cumprod(up), np.cumprod(down)])
    half = len(_POWERS) // 2
    return _POWERS[:half], _POWERS[half:]


def shingles(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of up to 2^OWNER_BITS texts, ascending within each text, and how many each text has."""
    text = pc.fill_null(text, "")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    rows = len(text)
    _, offsets, data = text.buffers()
    bound = np.frombuffer(offsets, np.int64)[text.offset : text.offset + rows + 1]
    raw = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data is not None and bound[-1] > bound[0] else np.zeros(0, np.uint8)
    bound = bound - bound[0]
    blank = _BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bound] = True
    word = ~blank
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
    words = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(bound, starts, "right") - 1
    per = np.bincount(owner, minlength=rows)
    rolled = words.copy()
    for k in range(1, n):
        rolled[:-k] = rolled[:-k] * _M[0] + words[k:]
    first = np.cumsum(per) - per
    place = np.arange(len(words)) - np.repeat(first, per)
    whole = place + n <= np.repeat(per, per)
    hashed, own = rolled[whole], owner[whole]
    for r in np.flatnonzero((per > 0) & (per < n)):
        h = int(per[r])
        for w in words[first[r] : first[r] + per[r]].tolist():
            h = ((h * int(_M[0]) + w) & (2**64 - 1)) ^ (h >> 7)
        hashed, own = np.append(hashed, np.uint64(h)), np.append(own, r)
    # one sort of text number and hash together
    key = np.sort((_mix(hashed) >> np.uint64(OWNER_BITS)) | (own.astype(np.uint64) << np.uint64(64 - OWNER_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _HASH, np.bincount((key >> np.uint64(64 - OWNER_BITS)).astype(np.int64), minlength=rows)


def _digests(hashed: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each set: two sums over independently mixed hashes."""
    out: list[bytes | None] = [None] * len(counts)
    full = np.flatnonzero(counts)
    if len(full):
        begin = (np.cumsum(counts) - counts)[full]
        sums = np.stack([np.add.reduceat(_mix(hashed ^ m), begin) for m in (_M[0], _M[1])], 1)
        for r, s in zip(full.tolist(), sums, strict=True):
            out[r] = s.astype("<u8").tobytes()
    return out


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for i in range(0, CELLS, CELL_BLOCK):
        if counts[i : i + CELL_BLOCK].any():
            yield i // CELL_BLOCK, squeeze.compress(counts[i : i + CELL_BLOCK].astype("<u2").tobytes())


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """A row (doc_id, text_hash, n_shingles, digest) for each document, and each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.uint16)
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, counts = shingles(part.column("text"), n)
                cells, times = np.unique(hashed & np.uint64(CELLS - 1), return_counts=True)
                cells = cells.astype(np.int64)
                sketch[cells] = np.minimum(65535, sketch[cells] + times.astype(np.uint32)).astype(np.uint16)
                nothing = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(_digests(hashed, counts), pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=schema)
        for block, data in _blocks(sketch):
            yield pa.RecordBatch.from_arrays([pa.array([None], k.type) if k.name not in ("block", "counts") else pa.array([block if k.name == "block" else data], k.type) for k in schema], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, n_shingles long, digest binary, block int, counts binary")


def _sketch(first: DataFrame) -> np.ndarray:
    """All tasks' counts summed block by block, as one byte a cell: rounded logarithms, which keep the order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(open_.decompress(data), "<u2").astype(np.uint32)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            level = np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zstandard.ZstdCompressor(level=3).compress(level.tobytes())], pa.binary())], ["block", "levels"])

    parts = map_arrow(first.where(F.col("block").isNotNull()).select("block", "counts").repartition(CELLS // CELL_BLOCK, "block"), add, "block int, levels binary")
    out = np.zeros(CELLS, np.uint8)
    for row in parts.collect():
        out[row["block"] * CELL_BLOCK : (row["block"] + 1) * CELL_BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["levels"])), np.uint8)
    return out


def _prefix_length(size: int, t: Fraction) -> int:
    """L: two similar sets have a shingle in common within so many first ones."""
    return size - math.ceil(t * size) + 1 if size else 0


def _common(size: int, t: Fraction) -> int:
    """l: so many they have in common within the prefix."""
    return min(_prefix_length(size, t), math.ceil(t * size))


def _sql_common(size: str, t: Fraction) -> str:
    """The same as an SQL expression."""
    least = f"(({t.numerator} * {size} + {t.denominator - 1}) div {t.denominator})"
    return f"least({size} - {least} + 1, {least})"


#: size and place of a posting in one number; a member's is its size, negative.
_PLACE_BITS = 24
_SECOND = "key long, group long, meta long, digest binary"


def _second_pass(docs: DataFrame, n: int, t: Fraction, sketch: np.ndarray) -> DataFrame:
    """Postings (key is a prefix shingle) of groups, and members (key is the group) with their class.

    A group's number is a hash of prefix and size; should two groups fall together, their members are verified
    as those of one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        groups: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                if len(met) > 500_000:
                    met.clear()
                    groups.clear()
                hashed, counts = shingles(part.column("text"), n)
                digest = _digests(hashed, counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                level = sent.value[(hashed & np.uint64(CELLS - 1)).astype(np.int64)]
                order = np.argsort((owner.astype(np.uint64) << np.uint64(54)) | (level.astype(np.uint64) << np.uint64(46)) | (hashed >> np.uint64(8)))
                ranked = hashed[order]
                begin = np.cumsum(counts) - counts
                length = np.array([_prefix_length(c, t) + _common(c, t) - 1 if c else 0 for c in counts.tolist()])
                place = np.arange(len(ranked)) - np.repeat(begin, counts)
                prefix = place < np.repeat(length, counts)
                full = np.flatnonzero(counts)
                group = np.zeros(len(counts), np.uint64)
                if len(full):
                    at = np.cumsum(length) - length
                    group[full] = _mix(np.add.reduceat(_mix(ranked[prefix] ^ _M[1]), at[full]) + counts[full].astype(np.uint64) * _M[0])
                group = group.view(np.int64)
                new, posted = np.zeros(len(counts), bool), np.zeros(len(counts), bool)
                for r in full.tolist():
                    if digest[r] not in met:
                        met.add(digest[r])
                        new[r] = True
                        if (g := int(group[r])) not in groups:
                            groups.add(g)
                            posted[r] = True
                rows = np.repeat(posted, counts) & prefix
                own, found = owner[rows], np.flatnonzero(new)
                if len(found):
                    meta = np.concatenate([(counts[own] << _PLACE_BITS) | np.minimum(place[rows], (1 << _PLACE_BITS) - 1), -counts[found]])
                    names = pa.array([None] * len(own) + [digest[r] for r in found.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ranked[rows].view(np.int64), group[found]])), pa.array(np.concatenate([group[own], group[found]])), pa.array(meta), names], ["key", "group", "meta", "digest"])

    return map_arrow(docs.select("text"), run, _SECOND)


def _shared(rows: DataFrame) -> DataFrame:
    """Postings whose shingle more than one group has, each group once; members as they are.

    A task holds a batch and one row of the list before it, however long lists are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        joined = False  # whether the last row's shingle has had another group
        for batch in batches:
            meta = batch.column("meta").to_numpy()
            if (meta < 0).any():
                yield batch.filter(pa.array(meta < 0))
                batch = batch.filter(pa.array(meta >= 0))
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key, group = now.column("key").to_numpy(), now.column("group").to_numpy()
            fresh_ = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
            now, key = now.filter(pa.array(fresh_)), key[fresh_]
            same = key[1:] == key[:-1]
            before, after = np.concatenate([[joined], same]), np.concatenate([same, [False]])
            before[0] = joined and last is not None
            yield from now.slice(0, len(key) - 1).filter(pa.array((before | after)[:-1])).to_batches()
            last, joined = now.slice(len(key) - 1).to_batches()[0], bool(before[-1])
        if last is not None and joined:
            yield last

    n = partitions(rows.sparkSession)
    return map_arrow(rows.repartition(n, "key").sortWithinPartitions("key", "group"), run, _SECOND)


def _sized(pair: DataFrame, t: Fraction) -> DataFrame:
    """Pairs whose sizes allow the similarity, each once."""
    alike = F.least("x_size", "y_size") * t.denominator >= F.greatest("x_size", "y_size") * t.numerator
    return pair.where(alike & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _hub_pairs(posted: DataFrame, t: Fraction) -> DataFrame:
    """Each group with the heaviest one (with most shared shingles) of each of its lists: pairs in proportion to the lists."""
    hubs = posted.groupBy("token").agg(F.max(F.struct("weight", "group", "size")).alias("hub")).select(F.col("token").alias("hub_token"), F.col("hub.group").alias("x"), F.col("hub.size").alias("x_size"))
    met = posted.join(hubs, F.col("token") == F.col("hub_token"))
    return _sized(met.select("x", "x_size", F.col("group").alias("y"), F.col("size").alias("y_size")), t)


def _filtered(pairs: DataFrame, groups: DataFrame, t: Fraction) -> DataFrame:
    """Those of distinct group pairs (x, y) that have as many prefix shingles in common as they must."""
    side = lambda key: groups.select(F.col("group").alias(key), F.col("tokens").alias(f"{key}_tokens"), F.expr(_sql_common("size", t)).alias(f"{key}_common"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    return met.where(F.size(F.array_intersect("x_tokens", "y_tokens")) >= F.least("x_common", "y_common")).select("x", "y")


_LISTED = ["token", "lo", "hi", "block", "group", "size", "place", "label", "other"]


def _lists(posted: DataFrame, most: int = LIST_ROWS) -> DataFrame:
    """Postings by list; a list longer than ``most`` is dealt into blocks that meet two by two."""
    counts = posted.groupBy(F.col("token").alias("long_token")).count()
    long_ = materialize(counts.where(F.col("count") > most).select("long_token", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    few = long_.count()
    if few:
        met = posted.join(F.broadcast(long_) if few <= BROADCAST_LISTS else long_, F.col("token") == F.col("long_token"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        met = posted.withColumn("blocks", F.lit(1))
    met = met.withColumn("block", F.pmod(F.xxhash64("group"), F.col("blocks")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("lo", F.least("block", "meets")).withColumn("hi", F.greatest("block", "meets")).select(*_LISTED)


def _cross_pairs(part: pa.Table, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Group pairs of a list that are of different components and, by size and place, could be similar."""
    columns = {c: part.column(c).to_numpy() for c in ("group", "size", "place", "label", "other", "block")}
    order = np.argsort(columns["size"], kind="stable")
    group, size, place, label, other, block = (columns[c][order] for c in ("group", "size", "place", "label", "other", "block"))
    split = part.column("lo")[0].as_py() != part.column("hi")[0].as_py()
    # sizes ascend, so that those within the similarity of a set stand in one stretch after it
    stop = np.searchsorted(size, size * t.denominator // t.numerator, "right")
    room = size - place
    xs, ys = [], []
    for i in range(len(size) - 1):
        js = np.arange(i + 1, stop[i])
        if not len(js):
            continue
        # a group of several components differs from all
        fit = (label[js] != label[i]) | (other[js] != other[i]) | (label[i] != other[i])
        if split:
            fit &= block[js] != block[i]
        need = -(-(t.numerator * (size[i] + size[js])) // (t.numerator + t.denominator))
        fit &= np.minimum(room[i], room[js]) >= need
        js = js[fit]
        if len(js):
            xs.append(np.full(len(js), group[i]))
            ys.append(group[js])
    none = np.zeros(0, np.int64)
    x, y = np.concatenate([none, *xs]), np.concatenate([none, *ys])
    return np.minimum(x, y), np.maximum(x, y)


def _in_lists(lists: DataFrame, t: Fraction) -> DataFrame:
    """Group pairs (x, y) of each whole list, each at least in the list of its first common shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table.column(c).to_numpy() for c in ("token", "lo", "hi")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
                if hi - lo > 1:
                    x, y = _cross_pairs(table.slice(lo, hi - lo), t)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key = np.stack([now.column(c).to_numpy() for c in ("token", "lo", "hi")])
            other = np.flatnonzero((key != key[:, -1:]).any(0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from settle(now.slice(0, cut).combine_chunks())
            held = now.slice(cut)
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    n = partitions(lists.sparkSession)
    ordered = lists.repartition(n, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return map_arrow(ordered, run, "x long, y long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those of distinct pairs (a, b) of classes whose sets are as similar as asked for, compared in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate([_unpacked(x.as_buffer()), _unpacked(y.as_buffer())])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(t.denominator * common >= t.numerator * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, x: sets.select(F.col("digest").alias(key), F.col("hashes").alias(x))
    return map_arrow(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y"), run, "a binary, b binary")


def _packed(hashed: np.ndarray) -> bytes:
    """SET_BYTES of each hash."""
    return (hashed >> np.uint64(64 - OWNER_BITS - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def _unpacked(data) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def _sets(docs: DataFrame, n: int, digests: DataFrame) -> DataFrame:
    """digest, hashes of the classes in ``digests`` and of few others, in one shuffle by digest."""
    least, most = FILTER_BITS
    n_bits = min(most, max(least, 1 << (16 * digests.count()).bit_length()))
    slot = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % n_bits
    words = digests.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect()
    bits = np.zeros(n_bits // 64, np.uint64)
    for row in words:
        bits[row["word"]] = np.uint64(row["bits"] & (2**64 - 1))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                if len(met) > 500_000:
                    met.clear()
                hashed, counts = shingles(part.column("text"), n)
                ends = np.cumsum(counts)
                keys, data = [], []
                for r, d in enumerate(_digests(hashed, counts)):
                    if d is None or d in met:
                        continue
                    at = int.from_bytes(d[:4], "big") % n_bits
                    if int(sent.value[at // 64]) >> (at % 64) & 1:
                        met.add(d)
                        keys.append(d)
                        data.append(_packed(hashed[ends[r] - counts[r] : ends[r]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["digest", "hashes"])

    return map_arrow(docs.select("text"), run, "digest binary, hashes binary").groupBy("digest").agg(F.first("hashes").alias("hashes"))


def components(links: DataFrame) -> DataFrame:
    """node, label (its component's least node) of all nodes of a table of links (a, b)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    last = None
    while (now := sign(edges)) != last and now[0]:
        last, old = now, edges
        # hooking: each node's larger neighbours to its least; then its smaller ones
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        small = hooked.select("u", F.col("m").alias("v")).unionByName(hooked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.where("u != v").distinct())
        discard(large, old)
    roots = edges.groupBy("u").agg(F.min("v").alias("label"))
    return roots.select(F.col("u").alias("node"), "label").unionByName(roots.select(F.col("label").alias("node"), "label").distinct())


def _labels(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """Classes with the component they are in, which is their own digest where they link with nothing."""
    return classes.join(joined, F.col("digest") == F.col("node"), "left").select(*classes.columns, F.coalesce("label", "digest").alias("label"))


def _pairs(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def join(docs: DataFrame, n: int = WORDS, similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, digest), and (node, label) of classes that link with another one."""
    t = similarity
    first = materialize(_first_pass(docs, n))
    rows = first.where(F.col("block").isNull()).select("doc_id", "text_hash", "n_shingles", "digest")
    second = materialize(_shared(_second_pass(docs, n, t, _sketch(first))))
    members = second.where("meta < 0").select("group", "digest").dropDuplicates(["digest"])
    place = F.expr(f"meta & {(1 << _PLACE_BITS) - 1}")
    token = F.struct(place.alias("place"), F.col("key").alias("token"))
    by_group = second.where("meta >= 0").groupBy("group").agg(F.first(F.shiftrightunsigned("meta", _PLACE_BITS)).alias("size"), F.collect_list(token).alias("listed"))
    # the smallest partner that a set can have decides how many shingles it must have in common
    smallest = f"(({t.numerator} * size + {t.denominator - 1}) div {t.denominator})"
    groups = materialize(by_group.where(F.size("listed") >= F.expr(_sql_common(smallest, t))).select("group", "size", "listed", F.col("listed.token").alias("tokens")))
    named = members.groupBy("group").agg(F.min("digest").alias("rep"), F.count("*").alias("n_members"))
    kept = named.join(groups.select(F.col("group").alias("paired")), F.col("group") == F.col("paired"), "left").where("paired is not null or n_members > 1").drop("paired")
    classes = materialize(members.join(kept, "group").select("group", "digest", "rep", "n_members"))
    discard(second)
    sets = materialize(_sets(docs, n, classes.select("digest")))
    reps = classes.where(F.col("digest") == F.col("rep")).select("group", "rep", "n_members")
    first_l = F.expr(f"size - (({t.numerator} * size + {t.denominator - 1}) div {t.denominator}) + 1")
    posted = groups.select("group", "size", F.size("listed").alias("weight"), F.explode("listed").alias("at")).where(F.col("at.place") < first_l).select("group", "size", "weight", F.col("at.place").alias("place"), F.col("at.token").alias("token"))
    # a representative of each group of a pair; and of each group with its other members
    hub = materialize(_filtered(_hub_pairs(posted, t), groups, t))
    side = lambda key: reps.select(F.col("group").alias(key), F.col("rep").alias(f"{key}_rep"), F.col("n_members").alias(f"{key}_n"))
    between = hub.join(side("x"), "x").join(side("y"), "y").select(*_pairs("x_rep", "y_rep"))
    within = classes.where(F.col("digest") != F.col("rep")).select(*_pairs("digest", "rep"))
    links = [materialize(_verify(between.unionByName(within).distinct(), sets, t))]
    joined = materialize(components(links[0]))
    # groups of one component need no more links; others meet wherever they share a list
    labelled = materialize(_labels(classes, joined))
    spread = labelled.groupBy("group").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    met = posted.join(spread, "group")
    mixed = met.groupBy("token").agg(F.min("label").alias("one"), F.max("other").alias("two")).where("one != two").select(F.col("token").alias("mixed"))
    open_ = materialize(met.join(mixed, F.col("token") == F.col("mixed"), "left_semi").select("token", "group", "size", "place", F.xxhash64("label").alias("label"), F.xxhash64("other").alias("other")))
    cross = materialize(_filtered(_in_lists(_lists(open_), t), groups, t))
    of = lambda key: labelled.select(F.col("group").alias(key), F.col("digest").alias(f"{key}_digest"), F.col("label").alias(f"{key}_label"), (F.col("digest") == F.col("rep")).alias(f"{key}_is_rep"))
    if not cross.isEmpty():
        star = cross.join(of("x"), "x").join(of("y").where("y_is_rep"), "y").unionByName(cross.join(of("x").where("x_is_rep"), "x").join(of("y"), "y"), allowMissingColumns=True)
        links.append(materialize(_verify(star.where("x_label != y_label").select(*_pairs("x_digest", "y_digest")).distinct(), sets, t)))
        if not links[-1].isEmpty():
            joined = materialize(components(links[0].unionByName(links[1])))
            labelled = materialize(_labels(classes, joined))
    # what is still apart: members besides the representatives, of a pair of groups and within a group
    apart = cross.join(of("x").where("not x_is_rep"), "x").join(of("y").where("not y_is_rep"), "y").where("x_label != y_label").select(*_pairs("x_digest", "y_digest"))
    several = labelled.groupBy("group").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one != two").select("group")
    inner = several.select(F.col("group").alias("x")).join(of("x").where("not x_is_rep"), "x").join(of("y").where("not y_is_rep"), F.col("x") == F.col("y")).where("x_label != y_label and x_digest < y_digest").select(*_pairs("x_digest", "y_digest"))
    rest = materialize(apart.unionByName(inner).distinct())
    if not rest.isEmpty():
        links.append(materialize(_verify(rest, sets, t)))
        if not links[-1].isEmpty():
            every = links[0]
            for more in links[1:]:
                every = every.unionByName(more)
            joined = materialize(components(every))
    discard(sets, groups, classes, hub, open_, cross, labelled, *links)
    return rows, joined


def _labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined, F.col("digest") == F.col("node"), "left").withColumn("label", F.coalesce("label", "digest")).drop("node")


def near_duplicates(docs: DataFrame, n: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows, joined = join(docs, n, similarity)
    # ids are brought together by class first, so that copies do not meet by component
    by_class = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("least"))
    labelled = _labelled(by_class, joined)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select(F.col("digest").alias("class"), "component_id")
    out = rows.join(named, F.col("digest") == F.col("class"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, without those that link with one of a smaller doc_id."""
    rows, joined = join(docs, n, similarity)
    doc, hash_, blank, nth, own = fresh(docs, "kept_doc", "kept_hash", "kept_blank", "kept_nth", "kept_own")
    by_class = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"))
    winners = _labelled(by_class, joined).groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(doc), F.col("least.text_hash").alias(hash_), F.lit(False).alias(blank))
    wordless = rows.where(F.col("digest").isNull()).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_), F.lit(True).alias(blank)).distinct()
    kept = winners.unionByName(wordless)
    met = docs.withColumn(own, F.xxhash64("text")).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hash_)))
    order = Window.partitionBy(doc, own).orderBy(F.xxhash64(*docs.columns))
    return met.withColumn(nth, F.row_number().over(order)).where(F.col(blank) | (F.col(nth) == 1)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
