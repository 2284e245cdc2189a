"""Aligns the tokens of two vocabularies over whole texts, and counts how often their tokens are linked.

Where tokens of both vocabularies end at the same byte the text is cut into groups; within a group the tokens whose
bytes overlap are linked.  Groups are interned: a block of documents is kept as numbers into its own dictionary of
groups, with how often each document has each.  The links of a group are expanded once for each distinct group.  How
many documents hold a pair of ids linked is counted block by block and summed; sums over the links of a group are
worked out once for each distinct group, join back to the blocks' dictionaries by the group's text, and are multiplied
by the documents' frequencies there.

Texts are encoded in units that no token of either vocabulary crosses: they begin at a blank or line end after another
character.  Texts with other white space, or with a unit whose tokens don't give back its bytes, are encoded whole.

Defined results: texts that are null or empty, or whose tokens don't give back the text, have zeros and ''; strings of
special tokens are ordinary text; repeated rows are documents of their own, also without an id; texts of any length are
aligned whole (the longest text sets what a task holds); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automaton import RARE_SPACES, Coder, Names, Ragged
from .common import kept_in_worker, map_arrow, materialize, slices, table

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: UTF-8 bytes of a block of documents; characters of units and numbers of groups that a worker keeps.
BLOCK_BYTES, STORE_CHARS, STORE_GROUPS = 4 << 20, 8_000_000, 1_500_000
_MARK, _LINE = "▁", "\n"
_UNITS = re.compile(r"[ \n]+[^ \n]*")


def links(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Places of the tokens of both sides that overlap, of a group."""
    out, i, j = [], 0, 0
    left, right = a_sizes[0], b_sizes[0]
    while True:
        out.append((i, j))
        both = min(left, right)
        left, right = left - both, right - both
        if not left:
            i += 1
            if i == len(a_sizes):
                return out
            left = a_sizes[i]
        if not right:
            j += 1
            right = b_sizes[j]


class Pieces:
    """The second vocabulary, a sentencepiece model: ids of units, and the bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(self.size)]
        labels = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.labels = Ragged()
        self.labels.add(np.frombuffer(b"".join(labels), np.uint8), self.sizes)
        if any(_MARK in p.lstrip(_MARK) or (_LINE in p and not m.is_byte(i)) for i, p in enumerate(pieces)):
            raise ValueError("the model has pieces over more than one unit")
        self.start = m.encode(_LINE)
        if [pieces[i] for i in self.start] != [_MARK, "<0x0A>"]:
            raise ValueError("the model treats line ends in another way")

    def units(self, units: list[str]) -> list[list[int]]:
        """Ids of units as they stand within a text: a line end before them never merges with them."""
        n = len(self.start)
        return [x[n:] if x[:n] == self.start else [] for x in self.model.encode([_LINE + u for u in units], num_threads=1)]


class Aligner:
    """Groups of texts; one for each worker and pair of files."""

    _own: dict[tuple[str, str], Aligner] = kept_in_worker({})

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = Coder.of(byte_path, False), Pieces(piece_path)
        self.a_text, self.b_text = [str(i) for i in range(self.a.automaton.size)], [str(i) for i in range(self.b.size)]
        self._clear()

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> Aligner:
        key = (byte_path, piece_path)
        if key not in cls._own:
            cls._own[key] = cls(*key)
        return cls._own[key]

    def _clear(self) -> None:
        self.units, self.groups, self.pairs = Names(), Names(), Names()
        #: per unit: its groups, whether it can be used, tokens of both sides, and its groups as text
        self.unit_groups, self.usable, self.n_a, self.n_b = Ragged(), [], [], []
        self.unit_text: list[str] = []
        #: per group: its text and its links, as numbers of pairs
        self.group_text: list[str] = []
        self.group_pairs = Ragged()
        self.pair_ids: list[int] = []

    def add(self, texts: list[str], a_ids: np.ndarray, a_counts: np.ndarray, b_lists: list[list[int]]) -> None:
        """Stores the groups of new units, in order, from their ids on both sides."""
        b_counts = np.fromiter(map(len, b_lists), np.int64, len(b_lists))
        b_ids = np.fromiter((i for x in b_lists for i in x), np.int64, int(b_counts.sum()))
        want = [t.encode() for t in texts]
        got = self.b.labels.take(b_ids).astype(np.uint8).tobytes()
        b_lengths = self.b.sizes[b_ids]
        sizes = np.fromiter(map(len, want), np.int64, len(want))
        total = np.concatenate([[0], np.cumsum(b_lengths)])
        b_ends = np.cumsum(b_counts)
        given = np.diff(total[np.concatenate([[0], b_ends])])
        usable = given == sizes
        if not usable.all() or got != b"".join(want):
            at = np.concatenate([[0], np.cumsum(given)]).tolist()
            usable = np.array([got[at[i] : at[i + 1]] == w for i, w in enumerate(want)], bool)
            # units that can't be used lose their tokens on both sides
            keep_a, keep_b = np.repeat(usable, a_counts), np.repeat(usable, b_counts)
            a_ids, b_ids, b_lengths = a_ids[keep_a], b_ids[keep_b], b_lengths[keep_b]
            a_counts, b_counts = a_counts * usable, b_counts * usable
        a_ends, b_ends = np.cumsum(self.a.automaton.sizes[a_ids]), np.cumsum(b_lengths)
        # tokens that close a group on either side
        close_a = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True)) + 1
        close_b = np.flatnonzero(np.isin(b_ends, a_ends, assume_unique=True)) + 1
        a_text, b_text = list(map(self.a_text.__getitem__, a_ids.tolist())), list(map(self.b_text.__getitem__, b_ids.tolist()))
        named, i, k = [], 0, 0
        for j, m in zip(close_a.tolist(), close_b.tolist(), strict=True):
            if j - i == 1 and m - k == 1:
                named.append(f"{a_text[i]}|{b_text[k]}")
            else:
                named.append(f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}")
            i, k = j, m
        ends = np.concatenate([[0], np.cumsum(a_counts)])
        per_unit = np.diff(np.searchsorted(close_a, ends, "right"))
        numbers = np.fromiter(map(self.groups.__getitem__, named), np.int64, len(named))
        self._expand()
        self.unit_groups.add(numbers, per_unit)
        self.usable += usable.tolist()
        self.n_a += a_counts.tolist()
        self.n_b += b_counts.tolist()
        at = 0
        for n in per_unit.tolist():
            self.unit_text.append(";".join(named[at : at + n]))
            at += n

    def _expand(self) -> None:
        """The links of the groups that are new."""
        flat, counts = [], []
        for name in self.groups.taken():
            self.group_text.append(name)
            found = self.links_of(name)
            flat += map(self.pairs.__getitem__, found)
            counts.append(len(found))
        self.pair_ids += self.pairs.taken()
        self.group_pairs.add(np.array(flat, np.int64), np.array(counts, np.int64))

    def links_of(self, name: str) -> list[int]:
        """The links of a group from its text, each as one number of both ids."""
        a, b = ([int(x) for x in part.split(",")] for part in name.split("|"))
        size = self.b.size
        if len(a) == 1 or len(b) == 1:
            return [i * size + j for i in a for j in b]
        a_sizes, b_sizes = self.a.automaton.sizes, self.b.sizes
        return [a[i] * size + b[j] for i, j in links([int(a_sizes[i]) for i in a], [int(b_sizes[j]) for j in b])]

    def _whole(self, texts: list[str]) -> list[int]:
        """Numbers of texts that are units of their own; -1 for those whose tokens don't give them back."""
        first = len(self.usable)
        for t in texts:
            self.units[first, len(self.units)] = len(self.units)
            self.units.chars += 4 * len(t)
        ids = [self.a.encode([" " + t])[0] for t in texts]
        self.add([" " + t for t in texts], np.concatenate(ids), np.array([len(x) for x in ids]), [self.b.model.encode(t) for t in texts])
        return [first + i if ok else -1 for i, ok in enumerate(self.usable[first:])]

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Units of each text, as numbers."""
        if self.units.chars > STORE_CHARS or len(self.groups) > STORE_GROUPS:
            self._clear()
        out: list[np.ndarray | None] = []
        none, place = np.zeros(0, np.int64), self.units.__getitem__
        for text in texts:
            if not text:
                out.append(none)
            elif any(c in text for c in RARE_SPACES):
                out.append(None)
            else:
                units = _UNITS.findall(" " + text)
                out.append(np.fromiter(map(place, units), np.int64, len(units)))
        new = self.units.taken()
        if new:
            self.add(new, *self.a.ids_of(new), self.b.units(new))
        usable = np.array(self.usable, bool)
        odd = [i for i, x in enumerate(out) if x is None or (len(x) and not usable[x].all())]
        if odd:
            for i, n in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = none if n < 0 else np.array([n])
        return out


_squeeze, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    return _squeeze.compress(values.astype(np.int32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_unpack.decompress(data), np.int32)


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))
_BLOCK = "block long, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string>>, per_doc binary, at binary, times binary, keys array<string>, pairs array<struct<a int, b int, n long>>"


def _block(aligner: Aligner, number: int, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """One block of documents: their numbers, groups by the block's own dictionary, and in how many each pair is linked."""
    found = aligner.numbers(texts)
    sizes = list(map(len, found))
    units = np.concatenate(found)
    n_a, n_b = np.array(aligner.n_a, np.int64), np.array(aligner.n_b, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    a, b = (np.diff(np.concatenate([[0], np.cumsum(n[units])])[ends]) for n in (n_a, n_b))
    groups, n_groups = aligner.unit_groups.take(units).astype(np.int64), aligner.unit_groups.grouped(units, sizes)
    shas = []
    for x in found:
        shas.append(hashlib.sha256(";".join(map(aligner.unit_text.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "")
    # which groups a document has, how often; which pairs it has linked
    doc = np.repeat(np.arange(len(found)), n_groups)
    every = len(aligner.groups)
    code, times = np.unique(doc * every + groups, return_counts=True)
    doc, group = np.divmod(code, every) if every else (code, code)
    linked = aligner.group_pairs.take(group).astype(np.int64)
    held = np.unique(np.repeat(doc, aligner.group_pairs.counts[group]) * len(aligner.pairs) + linked)
    pair, n = np.unique(held % max(1, len(aligner.pairs)), return_counts=True)
    own, at = np.unique(group, return_inverse=True)
    ids = np.array([aligner.pair_ids[i] for i in pair.tolist()], np.int64)
    docs = pa.array([dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r, strict=True)) for r in zip(doc_ids, a.tolist(), b.tolist(), n_groups.tolist(), (a + b - n_groups).tolist(), shas, strict=True)], _DOCS.value_type)
    pairs = pa.StructArray.from_arrays([pa.array(ids // aligner.b.size, pa.int32()), pa.array(ids % aligner.b.size, pa.int32()), pa.array(n, pa.int64())], ["a", "b", "n"])
    keys = pa.array([aligner.group_text[i] for i in own.tolist()], pa.string())
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    packed = [pa.array([_pack(x)], pa.binary()) for x in (np.bincount(doc, minlength=len(found)), at, times)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole(docs), *packed, whole(keys), whole(pairs)], ["block", "docs", "per_doc", "at", "times", "keys", "pairs"])


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Tokens, groups and links of every document; paths must be readable on every executor."""
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_MODEL), piece_path or public_tokenizers.path(PIECE_MODEL)

    def intern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                yield _block(aligner, number, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                number += 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(byte_path, piece_path)
        size = aligner.b.size
        for batch in batches:
            keys = batch.column("key").to_pylist()
            found = [aligner.links_of(k) for k in keys]
            owner = np.repeat(np.arange(len(keys)), [len(x) for x in found])
            ids = np.fromiter((i for x in found for i in x), np.int64, len(owner))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner)), pa.array(ids // size, pa.int32()), pa.array(ids % size, pa.int32())], ["key", "a", "b"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                per_doc, at, times = (_unpacked(row[c]).astype(np.int64) for c in ("per_doc", "at", "times"))
                sums = np.array([(s["at"], s["total"], s["best"]) for s in row["sums"] or []], np.int64).reshape(-1, 3)
                of = np.zeros((len(sums), 2), np.int64)
                of[sums[:, 0]] = sums[:, 1:]
                running = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(of[at] * times[:, None], axis=0)])
                ends = np.concatenate([[0], np.cumsum(per_doc)])
                count, best = (running[ends[1:]] - running[ends[:-1]]).T
                cols = {c: [d[c] for d in row["docs"]] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                kinds = [pa.int64()] * 5
                out = [pa.array(cols[c], k) for c, k in zip(("doc_id", "n_a", "n_b", "n_groups", "n_links"), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(best), pa.array(count), pa.array(cols["groups_sha256"], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    blocks = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(intern, _BLOCK))
    pairs = blocks.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    # an id has no more partners than the other vocabulary has ids
    pairs = pairs.withColumn("top", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    keys = blocks.select("block", F.posexplode("keys").alias("at", "key"))
    linked = keys.select("key").distinct().mapInArrow(expand, "key string, a int, b int")
    groups = linked.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("n").alias("total"), F.count_if("top").alias("best"))
    # a block has no more groups than its documents have bytes
    sums = keys.join(groups, "key").groupBy("block").agg(F.collect_list(F.struct("at", "total", "best")).alias("sums"))
    rows = blocks.select("block", "docs", "per_doc", "at", "times").join(sums, "block", "left")
    return map_arrow(rows, sum_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
