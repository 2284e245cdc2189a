"""Packs whole documents into sequences of bounded length by bounded-space online best fit.

Token ids are those of the ``tokenizers`` library.  For a byte-level vocabulary whose ids follow the order of
its merges, ``tiktoken`` gives the same ids in a third of the time and is used; texts that hold a special
string or a very long run of white space, and other vocabularies, go to the library itself.  Pieces are dealt by hash into tasks of bounded
size and packed online, in the order of their hash.  A bitset keyed by free space finds the fullest open bin
that still holds a piece; when all bins are open, the fullest closes first.

Defined results: null and empty texts are one piece with the end id alone; texts of any length are encoded
whole and cut into pieces; repeated rows are packed as often as they come; pieces with the same hash go by
doc_id and piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, map_slices, materialize, table

MODEL = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 0
#: Bins that are open at a time, and pieces that a task packs on average.
OPEN_BINS, PIECES_PER_TASK = 256, 20_000
#: Fixed value: the pre-tokens of the byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From so many characters of white space in a row a text goes to the library: the other encoder's patterns run out of stack.
LONG_RUN = 10_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}


class Encoder:
    """Texts to the bytes of their little-endian unsigned 32-bit ids; one for each worker and model."""

    _own: dict[str, Encoder] = kept_in_worker({})

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, spec: dict):
        """An encoder of ordinary text with the same ids, where the model is a plain byte-level one."""
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("dropout"):
            return None
        byte_of, ids = _byte_of(), {k: v for k, v in model["vocab"].items() if k not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [ids.get(a + b) for a, b in merges]
        if None in order or order != sorted(order) or len(ids) != 256 + len(set(order)) or any(c not in byte_of for k in ids for c in k):
            return None
        ranks = {bytes(byte_of[c] for c in k): v for k, v in ids.items()}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.plain is None or any(s in text for s in self.special) or (len(text) >= LONG_RUN and _RUN.search(text)):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.plain(text)
            out.append(np.array(ids, "<u4").tobytes())
        return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, after a shorter first one if it doesn't divide."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = int(end_id).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        ids = batch.column("doc_id").to_pylist()
        for doc, data in zip(ids, Encoder.of(path)([t or "" for t in batch.column("text").to_pylist()]), strict=True):
            data += end
            out += [(doc, i, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(data) // 4, capacity))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin and place of a piece."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        if space > length:
            self.free[space - length].append(number)
            self.bits |= 1 << (space - length)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return number


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which should be materialized: it is counted first."""
    tasks = max(1, math.ceil(found.count() / per_task))
    keys = ["doc_id", "piece", "ids_crc32"]
    # the order in which pieces arrive: the same in each run, and no other than chance
    arrival = [F.xxhash64(*keys), *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            put = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([at for _, at in put], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.repartition(tasks, *keys).sortWithinPartitions(*arrival).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents' pieces with their places; ``path`` must be readable on every executor."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return pack(materialize(pieces(docs, path)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
