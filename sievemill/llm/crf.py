"""A linear-chain conditional random field over words, in numpy.

Emissions are sums of hashed character n-gram weights (those that touch a word edge are its affixes),
of the whole word, of lexicon entries and, if asked for, of the same features of the words before and
after.  Transitions are learned, from token labels or from labels of whole sequences.  Forward-backward runs exactly on
sequences of any length: each is cut into blocks, the blocks' transfer matrices are chained, and the
blocks are then swept together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18
GRAMS = (2, 3, 4, 5)
BLOCK = 64
#: Words that a worker keeps scored; beyond it the store starts anew, which costs time and changes no result.
STORE = 150_000
#: UTF-8 bytes of text that a worker tags at a time.
TAGGED = 1 << 18
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LEFT, _RIGHT = "\x02", "\x03"


def normal(word: str) -> str:
    """Lower-cased letters and inner marks of a blank-separated word; empty if it has no letter."""
    low = word.lower()
    if low.isalpha():
        return low
    return "".join(c for c in low if c.isalpha() or c in "'-").strip("'-")


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in one array, and where each word's begin (every word has one at least)."""
    joined = "".join(f"{_LEFT}{w}{_RIGHT}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(points))
    shift = np.uint64(64 - BITS)
    owners, numbers = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling * _MULT[0]
        rolling[: len(points) - n + 1] += (points[n - 1 :] + np.uint64(1)) * _MULT[1]
        if n in GRAMS:
            mixed = rolling ^ (rolling >> np.uint64(29))
            mixed = mixed * _MULT[n - 1]
            keep = room >= n
            owners.append(owner[keep])
            numbers.append((mixed >> shift)[keep].astype(np.int64))
    power = np.cumprod(np.concatenate([[1], np.full(max(int(sizes.max(initial=1)) - 1, 0), _MULT[2], np.uint64)]).astype(np.uint64))
    whole = np.add.reduceat((points + np.uint64(7)) * power[np.arange(len(points)) - np.repeat(ends - sizes, sizes)], ends - sizes)
    whole = (whole ^ (whole >> np.uint64(31))) * _MULT[3]
    owners.append(np.arange(len(words)))
    numbers.append((whole >> shift).astype(np.int64))
    listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    owners.append(np.flatnonzero(listed >= 0))
    numbers.append((1 << BITS) + listed[listed >= 0])
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(owner, kind="stable")
    owner, number = owner[order], number[order]
    return number, np.searchsorted(owner, np.arange(len(words)))


@dataclass
class Blocks:
    """Blocks of at most BLOCK tokens, longer ones first; their t-th tokens stand together, so that a sweep reads in order."""

    perm: np.ndarray
    active: list[int]
    first: np.ndarray
    chain: list[np.ndarray]
    follow: list[np.ndarray]

    @classmethod
    def of(cls, counts: np.ndarray) -> Blocks:
        """counts: tokens of each sequence, none of them 0."""
        per = (counts + BLOCK - 1) // BLOCK
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(np.cumsum(counts) - counts, per) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(counts, per) - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        active = [int(np.searchsorted(-length[order], -t)) for t in range(BLOCK)]
        perm = np.concatenate([start[order[:c]] + t for t, c in enumerate(active)])
        chain = np.split(rank[np.argsort(nth, kind="stable")], np.cumsum(np.bincount(nth))[:-1])
        # follow[j]: of the sequences with a block j, which have a block j + 1
        return cls(perm, active, nth[order] == 0, chain, [per[per > j] > j + 1 for j in range(len(chain))])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (x @ np.ones((x.shape[-1], 1), x.dtype))


def sweep(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False, stay: np.ndarray | None = None, weigh=None):
    """Marginals of every token; with ``pairs`` also the expected transitions and first labels.

    ``stay`` takes, for each token, the probability of label 0 after labels 0 only: their product is that of a
    sequence without another label.  ``weigh`` makes weights of the tokens of it, for the expected transitions.
    """
    n, k = emission.shape
    expected, begun = np.zeros((k, k)), np.zeros(k)
    if not n:
        return np.zeros((n, k)), expected, begun
    b = Blocks.of(counts)
    e = emission[b.perm]
    e = np.exp(e - e.max(1, keepdims=True)) + 1e-30
    m = np.exp(transition - transition.max())
    s = _unit(np.exp(start - start.max())[None])[0]
    nb = len(b.first)
    at = np.cumsum([0, *b.active])
    reach, leave = np.tile(s, (nb, 1)), np.full((nb, k), 1.0 / k)
    if len(b.chain) > 1:
        transfer = np.tile(np.eye(k), (nb, 1, 1))
        for t, c in enumerate(b.active):
            if not c:
                break
            step = (transfer[:c].reshape(-1, k) @ m).reshape(c, k, k)
            if t == 0:
                step[b.first[:c]] = np.eye(k)
            step *= e[at[t] : at[t + 1], None, :]
            if t % 6 == 5:
                step /= step.max((1, 2), keepdims=True)
            transfer[:c] = step
        transfer /= transfer.max((1, 2), keepdims=True)
        for j in range(len(b.chain) - 1):
            before = b.chain[j][b.follow[j]]
            reach[b.chain[j + 1]] = _unit(np.einsum("bi,bij->bj", reach[before], transfer[before]))
        for j in range(len(b.chain) - 2, -1, -1):
            after = b.chain[j + 1]
            leave[b.chain[j][b.follow[j]]] = _unit(np.einsum("bij,bj->bi", transfer[after], leave[after]))
    ahead = np.empty((n, k))
    now = reach
    for t, c in enumerate(b.active):
        if not c:
            break
        step = now[:c] @ m
        if t == 0:
            step[b.first[:c]] = now[:c][b.first[:c]]
        step *= e[at[t] : at[t + 1]]
        now = ahead[at[t] : at[t + 1]] = _unit(step)
    behind, back = leave, m.T.copy()
    result = np.empty((n, k))
    joint: list[tuple] = []
    for t in range(BLOCK - 1, -1, -1):
        c = b.active[t]
        if not c:
            continue
        lo, hi = at[t], at[t + 1]
        result[lo:hi] = ahead[lo:hi] * behind[:c]
        seen = e[lo:hi] * behind[:c]
        if pairs:
            inner = np.ones(c, bool) if t else ~b.first[:c]
            prior = (ahead[at[t - 1] : at[t - 1] + c] if t else reach[:c])[inner]
            mass = ((prior @ m) * seen[inner]).sum(1, keepdims=True)
            if weigh is None:
                expected += m * ((prior / mass).T @ seen[inner])
            else:
                joint.append((b.perm[lo:hi][inner], prior / mass, seen[inner]))
        if stay is not None:
            stay[b.perm[lo:hi]] = m[0, 0] * seen[:, 0] / (seen @ m[0])
        behind[:c] = _unit(seen @ back)
    out = np.empty((n, k))
    out[b.perm] = _unit(result)
    first = np.cumsum(counts) - counts
    if stay is not None:
        stay[first] = out[first, 0]
    if pairs:
        weights = np.ones(n) if weigh is None else weigh(stay)
        for place, prior, seen in joint:
            expected += m * ((prior * weights[place][:, None]).T @ seen)
        begun = weights[first] @ out[first]
    return out, expected, begun


@dataclass
class Model:
    """What a prediction needs: label names, feature weights, transitions, start weights, lexicon.

    With context there are three weights for each label: of a word's own tag, the next word's and the one's before.
    """

    labels: list
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str], slice_: int = 2048) -> np.ndarray:
        """Scores of words, a slice at a time: features take some hundred times the room of a word."""
        out = np.empty((len(words), self.weights.shape[1]))
        for lo in range(0, len(words), slice_):
            number, begin = features(words[lo : lo + slice_], self.lexicon)
            sizes = np.diff(np.append(begin, len(number)))
            out[lo : lo + slice_] = np.add.reduceat(self.weights[number].astype(np.float64), begin, axis=0) / np.sqrt(sizes)[:, None]
        return out


def in_context(table: np.ndarray, tokens: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Emissions of tokens from a table of words, with what their neighbours in the sequence add if it has that."""
    e = table[tokens, :k]
    if table.shape[1] > k:
        first = np.zeros(len(tokens) + 1, bool)
        first[np.cumsum(counts) - counts] = True
        inner = ~first[1:-1]
        e[1:] += table[tokens[:-1], k : 2 * k] * inner[:, None]
        e[:-1] += table[tokens[1:], 2 * k :] * inner[:, None]
    return e


def _compact(words: list[str], lexicon: dict[str, int] | None = None, slice_: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that any word has, each word's as places among these, and how many each word has; a slice of words at a time."""
    parts, sizes = [], []
    for lo in range(0, len(words), slice_):
        number, begin = features(words[lo : lo + slice_], lexicon or {})
        parts.append(number.astype(np.int32))
        sizes.append(np.diff(np.append(begin, len(number))))
    number = np.concatenate(parts)
    seen = np.zeros((1 << BITS) + max((lexicon or {}).values(), default=-1) + 1, bool)
    seen[number] = True
    used = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, place[number], np.concatenate(sizes)


def fit_bags(sequences: list[list[str]], marked: np.ndarray, seeds: list[np.ndarray], warm: int = 24, steps: int = 36, rate: float = 0.15, decay: float = 2e-5, beside: float = 10.0, bias: float = -5.0, doubt: float = 0.05, chunk: int = 40_000) -> Model:
    """Tags 0 and 1 from labels of whole sequences: an unmarked one has no tag 1, a marked one has one at least.

    Maximizes the likelihood of these two events.  Its gradient is the expected counts, less those of a sequence of
    tags 0, times -1 or, for a marked sequence, times the odds of the event that it rules out: an expectation step
    over the tags of marked sequences in each step.  In the first ``warm`` steps, marked sequences that have a seed
    take the seeds as their tags.  ``doubt`` is the chance that a mark is wrong, which bounds those odds.
    Sequences are swept a chunk at a time.
    """
    index: dict[str, int] = {}
    tokens = np.fromiter((index.setdefault(w, len(index)) for s in sequences for w in s), np.int64)
    counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
    seed = np.concatenate(seeds).astype(float)
    used, compact, sizes = _compact(list(index))
    begin = np.cumsum(sizes) - sizes
    scale = 1 / np.sqrt(sizes)
    ends = np.cumsum(counts)
    seeded = np.add.reduceat(seed, ends - counts) > 0
    cuts = [0, *(np.flatnonzero(np.diff(ends // chunk)) + 1).tolist(), len(counts)]
    p = [np.zeros((len(used), 3)), np.zeros((2, 2)), np.zeros(2)]
    p[1][:, 1], p[2][1] = bias, bias
    shrink = [decay * np.array([1, beside, beside]), 0.0, 0.0]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        by_word = np.stack([np.add.reduceat(p[0][:, j][compact], begin) for j in range(3)], 1) * scale[:, None]
        gap, grads = np.zeros((len(index), 3)), [p[0], np.zeros((2, 2)), np.zeros(2)]
        free = marked if step > warm else marked & ~seeded
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            part = slice(ends[lo] - counts[lo], ends[hi - 1])
            own, length, open_ = tokens[part], counts[lo:hi], free[lo:hi]
            first = np.cumsum(length) - length
            inner = np.ones(len(own) + 1, bool)
            inner[first] = False
            inner = inner[1:-1]
            e = np.zeros((len(own), 2))
            e[:, 1] = in_context(by_word, own, length, 1)[:, 0]
            held: list[np.ndarray] = []

            def weigh(stay: np.ndarray, first=first, length=length, open_=open_, held=held) -> np.ndarray:
                none = np.exp(np.add.reduceat(np.log(np.maximum(stay, 1e-300)), first))
                odds = none * (1 - 2 * doubt) / ((1 - doubt) * (1 - none) + doubt * none + 1e-9)
                held.append(np.repeat(np.where(open_, odds, -1.0), length))
                return held[0]

            marginal, expected, begun = sweep(e, length, p[1], p[2], pairs=True, stay=np.empty(len(own)), weigh=weigh)
            weights = held[0]
            # what the tags should be: those of the seeds, or all 0 where the sequence is free
            gold = np.where(np.repeat(open_, length), 0.0, seed[part])
            tag = gold.astype(int)
            grads[2] += begun - np.bincount(tag[first], weights[first], 2)
            grads[1] += expected - np.bincount(2 * tag[:-1][inner] + tag[1:][inner], weights[1:][inner], 4).reshape(2, 2)
            push = weights * (marginal[:, 1] - gold)
            gap[:, 0] += np.bincount(own, push, len(index))
            gap[:, 1] += np.bincount(own[:-1], push[1:] * inner, len(index))
            gap[:, 2] += np.bincount(own[1:], push[:-1] * inner, len(index))
        gap *= scale[:, None]
        grads[0] = np.stack([np.bincount(compact, np.repeat(gap[:, j], sizes), len(used)) for j in range(3)], 1)
        for i, g in enumerate(grads):
            g = g / len(counts) - shrink[i] * p[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            p[i] = p[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros((1 << BITS, 6), np.float32)
    weights[used, 1::2] = p[0]
    return Model([0, 1], weights, p[1], p[2], {})


def fit(sequences: list[list[str]], tags: list[np.ndarray], labels: list, lexicon: dict[str, int], steps: int = 40, rate: float = 0.25, decay: float = 1e-4) -> Model:
    """Maximum conditional likelihood by Adam over all sequences at once."""
    k = len(labels)
    index: dict[str, int] = {}
    tokens = np.fromiter((index.setdefault(w, len(index)) for s in sequences for w in s), np.int64)
    counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
    gold = np.concatenate(tags)
    used, compact, sizes = _compact(list(index), lexicon)
    begin = np.cumsum(sizes) - sizes
    scale = 1 / np.sqrt(sizes)
    first = np.cumsum(counts) - counts
    gold_pairs = np.zeros((k, k))
    inner = np.ones(len(gold), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    np.add.at(gold_pairs, (gold[at - 1], gold[at]), 1)
    gold_start = np.bincount(gold[first], minlength=k).astype(float)
    gold_word = np.stack([np.bincount(tokens[gold == j], minlength=len(index)) for j in range(k)], 1).astype(float)
    p = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    total = len(tokens)
    for step in range(1, steps + 1):
        # one label at a time: all at once would be the largest array of all
        by_word = np.stack([np.add.reduceat(p[0][:, j][compact], begin) for j in range(k)], 1) * scale[:, None]
        marginal, expected, begun = sweep(by_word[tokens], counts, p[1], p[2], pairs=True)
        gap = gold_word - np.stack([np.bincount(tokens, marginal[:, j], len(index)) for j in range(k)], 1)
        gap *= scale[:, None]
        grads = [np.stack([np.bincount(compact, np.repeat(gap[:, j], sizes), len(used)) for j in range(k)], 1) / total - decay * p[0], (gold_pairs - expected) / total - decay * p[1], (gold_start - begun) / total - decay * p[2]]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            p[i] = p[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(((1 << BITS) + max(lexicon.values(), default=-1) + 1, k), np.float32)
    weights[used] = p[0]
    return Model(labels, weights, p[1], p[2], lexicon)


class Words(dict):
    """Numbers of blank-separated words; a new word gets the next number.  Words without a letter get -1."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.pending, self.table = [], np.zeros((0, self.model.weights.shape[1]))

    def __missing__(self, word: str) -> int:
        plain = normal(word)
        if not plain:
            self[word] = -1
            return -1
        number = self[word] = len(self.table) + len(self.pending)
        self.pending.append(plain)
        return number

    def scored(self) -> np.ndarray:
        if self.pending:
            self.table = np.concatenate([self.table, self.model.emissions(self.pending)])
            self.pending = []
        return self.table


def tag(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of all words with a letter of all texts, and how many each text has."""
    if len(words) > STORE:
        words.empty()
    ids = [np.fromiter(map(words.__getitem__, (t or "").split()), np.int64) for t in texts]
    ids = [x[x >= 0] for x in ids]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    e = in_context(words.scored(), flat, counts[counts > 0], len(words.model.labels))
    marginal, _, _ = sweep(e, counts[counts > 0], words.model.transition, words.model.start)
    return marginal, counts


def by_text(values: np.ndarray, counts: np.ndarray, how=np.add) -> np.ndarray:
    """Sum (or another reduction) of token values for each text; 0 for texts without tokens."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        out[full] = how.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out
