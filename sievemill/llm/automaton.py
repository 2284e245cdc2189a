"""Byte-level BPE as a deterministic automaton over tokens: encoding by table lookups, decoding by arc labels.

The automaton starts as one state with an arc for every byte.  Each merge of u and v into w adds one gadget:
arcs labelled u then lead to a copy of their old end that has lost the arc v, and wherever u could be followed
by v there is an arc w to where v led.  Arcs with one label all lead to one state, so a state is kept as the
state it was copied from and the arc it lost, and an arc test follows these differences.  What the finished
automaton accepts is exactly what applying the merges in order gives, so each prefix of a word has one path.

To encode, words that the pre-tokenizer splits off are walked byte by byte, a whole batch at a time: every
token that ends at a place is tried from the state at its start, and just one has an arc there.  To decode,
labels are joined.

Defined results: null and empty texts have no tokens; special strings inside texts are their own token; ids
without a label are left out when decoding, as the library does; equal texts have equal rows; repeated rows stay;
texts and words of any length are encoded whole (a word beyond LONG bytes by itself, in linear time); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_in_worker, map_slices, table
from .packing import PATTERN, _byte_of

MODEL = "byte_bpe_50k.json"
#: Characters of units that a worker keeps encoded; words longer than LONG bytes are walked one by one.
STORE_CHARS, LONG = 10_000_000, 200
#: Places (words times bytes) that one step walks.
PLACES = 2_000_000
_ROOT = 0
#: White space beside blanks and line ends; texts that hold it are split as a whole.
RARE_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_UNITS = re.compile(r"[ \n]+[^ \n]*|^[^ \n]+")
#: Up to here the classes of letters, numbers and white space are old enough to be the same everywhere.
_SETTLED = re.compile("[\0-՗]*")


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that belong to ``items``, one after the other."""
    n = counts[items]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(starts[items] - (ends - n), n)]


class Lookup:
    """A table from non-negative 64-bit keys to numbers, asked for many keys at a time (open addressing); -1 if absent."""

    def __init__(self, entries: dict[int, int]):
        bits = max(8, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys, values = np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int64, len(entries))
        place = self._place(keys)
        while len(keys):
            # of keys that want the same free place the first gets it, the others go on
            free = self.keys[place] < 0
            won = np.zeros(len(keys), bool)
            won[np.flatnonzero(free)[np.unique(place[free], return_index=True)[1]]] = True
            self.keys[place[won]], self.values[place[won]] = keys[won], values[won]
            keys, values, place = keys[~won], values[~won], (place[~won] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.values[place], -1)
        at = np.flatnonzero((found != keys) & (found >= 0))
        while len(at):
            place[at] = (place[at] + 1) & self.mask
            found = self.keys[place[at]]
            hit = found == keys[at]
            out[at[hit]] = self.values[place[at[hit]]]
            at = at[~hit & (found >= 0)]
        return out


class Automaton:
    """States and arcs compiled from the merges ``(u, v, w)`` of token ids; ``labels`` has each token's bytes."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(labels) + 1
        self.size = size
        usable = {t for t, b in labels.items() if len(b) == 1}
        #: the gadget by which arcs of a token lost one, by token * size + lost arc
        gadget: dict[int, int] = {}
        # per token: the gadget that made it, its left part, the state its arcs first led to, and lead to now
        made, left, first, target = ([0] * size for _ in range(4))
        # per state: the token whose arcs its gadget turned to it
        owner = [-1] * (len(merges) + 1)

        def arc(state: int, token: int) -> bool:
            own, bound = owner[state], state
            while own >= 0:
                if gadget.get(own * size + token, bound + 1) <= bound:
                    return False
                if made[token] > made[own]:
                    bound, token = min(bound, made[token]), left[token]
                else:
                    bound = first[own]
                    own = owner[bound]
            return True

        for k, (u, v, w) in enumerate(merges, 1):
            if w in usable:
                raise ValueError("two merges make the same token")
            if u not in usable or v not in usable or not arc(target[u], v):
                continue  # never applies
            usable.add(w)
            made[w], left[w], first[w], target[w] = k, u, target[v], target[v]
            owner[k], target[u], gadget[u * size + v] = u, k, k
        self.made, self.left, self.first, self.target, self.owner = (np.array(x, np.int64) for x in (made, left, first, target, owner))
        self.lost = Lookup(gadget)
        self._arc, self._known = arc, {}
        self._labels(labels, usable)

    def _labels(self, labels: dict[int, bytes], usable: set[int]) -> None:
        step: dict[int, int] = {}
        ends: list[int] = [-1]
        for token in sorted(usable):
            node = _ROOT
            for b in labels[token]:
                key = node << 8 | b
                node = step.get(key, -1)
                if node < 0:
                    node = step[key] = len(ends)
                    ends.append(-1)
            ends[node] = token
        self.step, self.ends = step, ends
        self.steps, self.end_of = Lookup(step), np.array(ends, np.int64)
        self.sizes = np.array([len(labels.get(t, b"")) for t in range(self.size)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(labels.get(t, b"") for t in range(self.size)), np.uint8)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with that token."""
        out = np.ones(len(states), bool)
        own, bound, token = self.owner[states], states, tokens
        at = np.flatnonzero(own >= 0)
        own, bound, token = own[at], bound[at], token[at]
        while len(at):
            by = self.lost(own * self.size + token)
            no = (by >= 0) & (by <= bound)
            out[at[no]] = False
            made = self.made[token]
            newer = made > self.made[own]
            bound = np.where(newer, np.minimum(bound, made), self.first[own])
            token = np.where(newer, self.left[token], token)
            own = np.where(newer, own, self.owner[bound])
            on = np.flatnonzero(~no & (own >= 0))
            at, own, bound, token = at[on], own[on], bound[on], token[on]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts = np.zeros(len(words), np.int64), []
        order = np.argsort(-sizes, kind="stable")
        lone = int((sizes > LONG).sum())
        for i in order[:lone]:
            ids = self._walk(words[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int64)))
        lo = lone
        while lo < len(order):
            hi = min(len(order), lo + max(1, PLACES // (int(sizes[order[lo]]) + 1)))
            own = order[lo:hi]
            ids, n = self._walk_all([words[i] for i in own.tolist()], sizes[own])
            counts[own] = n
            parts.append((own, ids))
            lo = hi
        if not parts:
            return np.zeros(0, np.int64), counts
        # back to the order of the words
        own = np.concatenate([p[0] for p in parts])
        flat = np.concatenate([p[1] for p in parts])
        starts = np.zeros(len(words), np.int64)
        starts[own] = np.cumsum(counts[own]) - counts[own]
        return ragged(flat, starts, counts, np.arange(len(words))), counts

    def _walk_all(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(words), int(sizes[0])
        if not most:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        wide = most + 1
        text = np.zeros((n, wide), np.uint8)
        text[np.arange(wide) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        text = text.ravel()
        # of each place in each word: the state there, the token that led to it and where that began
        state, token, back = (np.zeros(n * wide, np.int64) for _ in range(3))
        live = np.searchsorted(-sizes, -np.arange(1, wide), "right").tolist()
        # walks under way: the first place of their word, where they began, and their node
        row = begin = node = np.zeros(0, np.int64)
        rows = np.arange(n) * wide
        for i in range(1, wide):
            m = live[i - 1]
            if i > 1 and m < live[i - 2]:
                stay = row < m * wide
                row, begin, node = row[stay], begin[stay], node[stay]
            row = np.concatenate([row, rows[:m]])
            begin = np.concatenate([begin, rows[:m] + (i - 1)])
            node = np.concatenate([node, np.zeros(m, np.int64)])
            to = self.steps(node << 8 | text[row + (i - 1)])
            hit = np.flatnonzero(to >= 0)
            row, begin, node = row[hit], begin[hit], to[hit]
            found = self.end_of[node]
            end = np.flatnonzero(found >= 0)
            b, t = begin[end], found[end]
            good = np.flatnonzero(self.arcs(state[b], t))
            b, t, place = b[good], t[good], row[end[good]] + i
            state[place], token[place], back[place] = self.target[t], t, b
        owners, found, who = [], [], np.flatnonzero(sizes)
        place = who * wide + sizes[who]
        while len(who):
            owners.append(who)
            found.append(token[place])
            place = back[place]
            stay = place > who * wide
            who, place = who[stay], place[stay]
        owner = np.concatenate(owners[::-1])
        return np.concatenate(found[::-1])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def _walk(self, word: bytes) -> list[int]:
        """The same for one long word: its state at each place, and the token that led there."""
        state, token, back = [0] * (len(word) + 1), [0] * (len(word) + 1), [0] * (len(word) + 1)
        live: list[tuple[int, int]] = []
        target, step, ends, known = self.target.tolist(), self.step, self.ends, self._known
        for i, byte in enumerate(word, 1):
            live.append((i - 1, _ROOT))
            moved = []
            for begin, node in live:
                node = step.get(node << 8 | byte, -1)
                if node < 0:
                    continue
                moved.append((begin, node))
                found = ends[node]
                if found >= 0:
                    key = state[begin] * self.size + found
                    ok = known.get(key)
                    if ok is None:
                        if len(known) > 500_000:
                            known.clear()
                        ok = known[key] = self._arc(state[begin], found)
                    if ok:
                        state[i], token[i], back[i] = target[found], found, begin
            live = moved
        out, i = [], len(word)
        while i:
            out.append(token[i])
            i = back[i]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Labels of the ids, joined; ids without one give nothing."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        return ragged(self.bytes, self.starts, self.sizes, ids).tobytes()


class Names(dict):
    """Numbers of texts in the order they come; new ones wait until a whole batch is dealt with."""

    def __init__(self):
        super().__init__()
        self.new: list = []
        self.chars = 0

    def __missing__(self, name) -> int:
        at = self[name] = len(self)
        self.new.append(name)
        self.chars += 16 + (0 if isinstance(name, int) else len(name))
        return at

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class Ragged:
    """Rows of unequal length that grow at the end, in one array."""

    def __init__(self):
        self.flat, self.size = np.zeros(1024, np.int32), 0
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        if self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.zeros(self.size + 2 * len(flat), np.int32)])
        self.flat[self.size : self.size + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.size + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.size += len(flat)

    def take(self, items: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.starts, self.counts, items)

    def grouped(self, items: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Sums of the row lengths of ``items``, which belong together by ``sizes``."""
        total = np.concatenate([[0], np.cumsum(self.counts[items])])
        return np.diff(total[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)])


class Coder:
    """Encodes and decodes texts for a byte-level BPE file of the ``tokenizers`` library; one for each worker and file."""

    _own: dict[tuple[str, bool], Coder] = kept_in_worker({})

    def __init__(self, path: str, specials: bool = True):
        """Without ``specials`` the strings of special tokens are ordinary text."""
        import regex
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        spec = json.loads(lib.to_str())
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model["type"] != "BPE" or spec["normalizer"] or not plain or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        added = lib.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added.values()):
            raise ValueError("special strings with rules of their own are not supported")
        self.special = {x.content: i for i, x in added.items()}
        ids, byte_of = model["vocab"], _byte_of()
        labels = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton(labels | {i: s.encode() for s, i in self.special.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
        self._find = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special and specials else None
        self._own_words, self._library_words = regex.compile(PATTERN).findall, lib.pre_tokenizer.pre_tokenize_str
        self._clear()

    @classmethod
    def of(cls, path: str, specials: bool = True) -> Coder:
        if (path, specials) not in cls._own:
            cls._own[path, specials] = cls(path, specials)
        return cls._own[path, specials]

    def _clear(self) -> None:
        self.units, self.named = Names(), Names()
        self.unit_ids, self.word_ids = Ragged(), Ragged()

    def words(self, text: str) -> list[str]:
        """The words that the pre-tokenizer splits a text into."""
        if _SETTLED.fullmatch(text):
            return self._own_words(text)
        return [text[a:b] for _, (a, b) in self._library_words(text)]

    def _parts(self, text: str) -> list:
        """The text as units that can be encoded one by one; a special string is a tuple of itself."""
        if self._find is not None and any(s in text for s in self.special):
            out: list = []
            for part in self._find.split(text):
                out += [(part,)] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if any(c in text for c in RARE_SPACES):
            return self.words(text)
        return _UNITS.findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if self.units.chars > STORE_CHARS:
            self._clear()
        place = self.units.__getitem__
        numbers, sizes = [], []
        for text in texts:
            units = self._parts(text) if text else []
            numbers.append(np.fromiter(map(place, units), np.int64, len(units)))
            sizes.append(len(units))
        self._learn()
        items = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        return self.unit_ids.take(items), self.unit_ids.grouped(items, sizes)

    def _learn(self) -> None:
        """Encodes the units that are new."""
        new = self.units.taken()
        if new:
            self.unit_ids.add(*self.ids_of(new))

    def ids_of(self, new: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has; only words that are new are walked."""
        if self.named.chars > STORE_CHARS:
            self.named, self.word_ids = Names(), Ragged()
        # units that begin where white space does, and end in none, make up a text that is split at once
        joins = [u[0] in " \n" and not u[-1].isspace() for u in new]
        joined = [u for u, j in zip(new, joins, strict=True) if j]
        words = self.words("".join(joined)) if joined else []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        parts = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), "right"), prepend=0).tolist()
        at, lo, order, sizes = iter(parts), 0, [], []
        for u, j in zip(new, joins, strict=True):
            if j:
                lo, own = lo + (n := next(at)), words[lo : lo + n]
            else:
                own = [u] if isinstance(u, tuple) else self.words(u)
            order += own
            sizes.append(len(own))
        place = self.named.__getitem__
        items = np.fromiter(map(place, order), np.int64, len(order))
        fresh = self.named.taken()
        ids, counts = self.automaton.encode([b"" if isinstance(w, tuple) else w.encode() for w in fresh])
        for i, w in enumerate(fresh):
            if isinstance(w, tuple):
                ids, counts[i] = np.insert(ids, int(counts[:i].sum()), self.special[w[0]]), 1
        self.word_ids.add(ids, counts)
        return self.word_ids.take(items), self.word_ids.grouped(items, sizes)

    def decode(self, ids: np.ndarray) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``with_ids`` also the ids and the decoded text.

    ``path`` must be readable on every executor.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder.of(path)
        ids, counts = coder.encode(batch.column("text").to_pylist())
        ends = np.cumsum(counts)
        raw = ids.astype("<u4")
        label_ends = np.concatenate([[0], np.cumsum(coder.automaton.sizes[ids])])
        decoded = coder.automaton.decode(ids)
        shas, texts = [], []
        for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            text = decoded[label_ends[lo] : label_ends[hi]].decode("utf-8", "replace")
            shas.append((hashlib.sha256(raw[lo:hi]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            if with_ids:
                texts.append(text)
        out = [batch.column("doc_id"), pa.array(counts), pa.array([a for a, _ in shas], pa.string()), pa.array([b for _, b in shas], pa.string())]
        if with_ids:
            out += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + [n for n, _ in more])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
