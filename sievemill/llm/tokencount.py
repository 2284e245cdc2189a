"""Token counts of whole texts for a sentencepiece BPE model, by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol numbers.  In every round each sequence
applies its lowest-ranked pair, at all places at once where that equals applying them from left to
right, and at the leftmost place else.  The symbols that survive are counted; a character outside the
vocabulary counts as its UTF-8 bytes (byte fallback).

Only blanks separate pre-tokens: the model is checked to have no piece with a blank after another
character.  Counts of pre-tokens are kept by a worker; the store is bounded and starts anew when full.

Defined results: null and empty texts have 0 bytes and 0 tokens; equal texts have equal counts; repeated
rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, map_slices, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens that a worker keeps counted.
STORE = 400_000
_MARK = "▁"
_RUNS = re.compile(r" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)


class Merger:
    """The model's pieces as arrays: symbol numbers, and the ranks of the pairs that form a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(_MARK in p.lstrip(_MARK) for p in score):
            raise ValueError("the model has pieces over more than one word")
        if [p.count(_MARK) for p in ("".join(model.encode(t, out_type=str)) for t in ("a", "  a ", " a  b"))] != [1, 4, 4]:
            raise ValueError("the model normalizes blanks in another way")
        self.known = set(score)
        letters = sorted({c for p in score for c in p} | {p for p in score if len(p) == 1})
        number = {c: i for i, c in enumerate(letters)}
        for p in score:
            number.setdefault(p, len(number))
        self.count = len(number)
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = sorted((number[p[:k]] * (self.count + 1) + number[p[k:]], ranks[s], number[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.keys = np.array([x[0] for x in found], np.int64)
        self.ranks = np.array([x[1] for x in found], np.int32)
        self.made = np.array([x[2] for x in found], np.int32)
        # tokens for a surviving symbol: 1, or its bytes if it is no piece
        self.cost = np.ones(self.count + 1, np.int64)
        for p, i in number.items():
            if p not in self.known:
                self.cost[i] = len(p.encode())

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of each pair; rank _NONE if it forms no piece."""
        key = left.astype(np.int64) * (self.count + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (blanks written as the blank mark)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        known = self.letters[at] == points
        symbol = np.where(known, at, self.count).astype(np.int32)
        out = np.zeros(len(words), np.int64)
        wide = points[~known]
        np.add.at(out, owner[~known], 1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF))
        self.cost[self.count] = 0
        while len(symbol):
            same = owner[1:] == owner[:-1]
            rank, made = self.pairs(symbol[:-1], symbol[1:])
            # of the pair that each symbol begins
            rank, made = np.append(np.where(same, rank, _NONE), _NONE), np.append(made, 0)
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, begin)
            live = np.repeat(least < _NONE, np.diff(np.append(begin, len(symbol))))
            if not live.all():
                np.add.at(out, owner[~live], self.cost[symbol[~live]])
                symbol, owner = symbol[live], owner[live]
                if not len(symbol):
                    break
                rank, made = rank[live], made[live]
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                least = least[least < _NONE]
            symbol, owner = self._round(symbol, owner, rank, made, begin, least)
        return out

    def _round(self, symbol, owner, rank, made, begin, least):
        n = len(symbol)
        seq = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        hit = np.flatnonzero(rank == least[seq])
        # of places that overlap, every other one, from the left
        joined = np.concatenate([[False], np.diff(hit) == 1])
        start = np.maximum.accumulate(np.where(~joined, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        new = symbol.copy()
        new[hit] = made[hit]
        gone = np.zeros(n, bool)
        gone[hit + 1] = True
        kept = np.flatnonzero(~gone)
        merged = np.zeros(n, bool)
        merged[hit] = True
        # places where a pair arises that ranks no higher than the one applied: there order matters
        after, own, fresh = new[kept], seq[kept], merged[kept]
        touched = np.flatnonzero((fresh[1:] | fresh[:-1]) & (own[1:] == own[:-1]))
        arisen, _ = self.pairs(after[touched], after[touched + 1])
        unsafe = own[touched][arisen <= least[own[touched]]]
        close = hit[:-1][(np.diff(hit) == 2) & (seq[hit[:-1]] == seq[hit[1:]])]
        between, _ = self.pairs(new[close], symbol[close + 2])
        unsafe = np.concatenate([unsafe, seq[close][between <= least[seq[close]]]])
        if len(unsafe):
            bad = np.zeros(len(begin), bool)
            bad[unsafe] = True
            first = np.zeros(len(hit), bool)
            first[np.unique(seq[hit], return_index=True)[1]] = True
            hit = hit[~bad[seq[hit]] | first]
            new = symbol.copy()
            new[hit] = made[hit]
            gone = np.zeros(n, bool)
            gone[hit + 1] = True
            kept = np.flatnonzero(~gone)
        return new[kept], owner[kept]


class _Store(dict):
    """Token counts of pre-tokens; new ones wait until a whole batch of them is merged."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger, self.new = merger, []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Counter:
    """Counts texts in batches; one for each worker and model."""

    _own: dict[str, Counter] = kept_in_worker({})

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.store, self.table = _Store(self.merger), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.store) > STORE:
            self.store, self.table = _Store(self.merger), np.zeros(0, np.int64)
        place = self.store.__getitem__
        numbers, sizes = [], []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            if _MARK in text:
                text = text.replace(_MARK, " ")
            if "  " in text or text[0] == " ":
                # runs of blanks may merge with each other; the store keeps them with their word
                words = [w[1:] for w in _RUNS.findall(" " + text)]
            else:
                words = text.split(" ")
            numbers.append(np.fromiter(map(place, words), np.int64, len(words)))
            sizes.append(len(words))
        if self.store.new:
            fresh = self.merger.counts([_MARK + w.replace(" ", _MARK) for w in self.store.new])
            self.table = np.concatenate([self.table, fresh])
            self.store.new = []
        sizes = np.array(sizes, np.int64)
        out = np.zeros(len(texts), np.int64)
        if numbers:
            full = sizes > 0
            out[full] = np.add.reduceat(self.table[np.concatenate(numbers)], (np.cumsum(sizes) - sizes)[full])
        return out


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path`` must be readable on every executor."""
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text")
        n_tokens = Counter.of(path)(text.to_pylist())
        n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
