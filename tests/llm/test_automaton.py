"""The token automaton against merging in order, the gadgets written out, and the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievemill.llm import automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", "e", "t", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "ß", "1", "23", "!", "...", "--", "<|endoftext|>", "<|endo", "　", "日", "本", "\U0001f600", "՘", "࢏", "\xa0", "\x85", "\r\n", "th", "ing", "ÃÂ", "\0", "\x1c"]


def small(seed, n=14):
    """A vocabulary over three letters with random merges, some of which never apply."""
    rnd = random.Random(seed)
    labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
    while len(merges) < n:
        u, v = rnd.randrange(len(labels)), rnd.randrange(len(labels))
        if labels[u] + labels[v] not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = labels[u] + labels[v]
    return labels, merges


def merged(word, labels, merges):
    number = {b: t for t, b in labels.items() if len(b) == 1}
    ids = [number[bytes([b])] for b in word]
    for u, v, w in merges:
        i, out = 0, []
        while i < len(ids):
            if ids[i : i + 2] == [u, v]:
                out.append(w)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def written_out(labels, merges):
    """The arcs of every state, with every gadget applied to all of them."""
    arcs = [{t: 0 for t, b in labels.items() if len(b) == 1}]
    for u, v, w in merges:
        ends = {a[u] for a in arcs if u in a}
        assert len(ends) <= 1
        if not ends or v not in arcs[next(iter(ends))]:
            continue
        old = next(iter(ends))
        to, copy = arcs[old][v], len(arcs)
        before = [u in a for a in arcs]
        arcs.append({t: s for t, s in arcs[old].items() if t != v})
        before.append(u in arcs[copy])
        for a, had in zip(arcs, before, strict=True):
            if had:
                a[w] = to
            if u in a:
                a[u] = copy
    return arcs


@pytest.mark.parametrize("seed", range(12))
def test_small_automata(seed):
    labels, merges = small(seed)
    a = automaton.Automaton(labels, merges)
    rnd = random.Random(seed)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12))) for _ in range(400)] + [b""]
    ids, counts = a.encode(words)
    ends = np.cumsum(counts)
    arcs = written_out(labels, merges)
    for word, lo, hi in zip(words, ends - counts, ends, strict=True):
        want = merged(word, labels, merges)
        assert ids[lo:hi].tolist() == want == a._walk(word)
        assert a.decode(ids[lo:hi]) == word
        state = 0
        for t in want:
            state = arcs[state][t]
    # after a token just those tokens can come that the written-out automaton has arcs for
    for t in range(len(labels)):
        ends_of = {x[t] for x in arcs if t in x}
        if ends_of:
            (end,) = ends_of
            got = {n for n in range(len(labels)) if n in {x for y in arcs for x in y} and a.arcs(np.array([a.target[t]]), np.array([n]))[0]}
            assert got == set(arcs[end])


def test_lookup():
    rnd = random.Random(3)
    entries = {rnd.randrange(1 << 40): i for i in range(5000)}
    look = automaton.Lookup(entries)
    keys = [*entries, *(rnd.randrange(1 << 40) for _ in range(5000))]
    assert look(np.array(keys)).tolist() == [entries.get(k, -1) for k in keys]


def test_texts_as_the_library(monkeypatch):
    lib, coder, rnd = Tokenizer.from_file(PATH), automaton.Coder(PATH), random.Random(7)
    monkeypatch.setattr(automaton, "STORE_CHARS", 20_000)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "x" * 1000 + " " * 500 + "==" * 700, "a" * 50_000, " " * 2_000_000, "\n" * 200_000 + "z", "no\tend" * 3000, "<|endoftext|>" * 50]
    for lo in range(0, len(texts), 100):
        ids, counts = coder.encode(texts[lo : lo + 100])
        ends = np.cumsum(counts)
        for text, a, b in zip(texts[lo : lo + 100], ends - counts, ends, strict=True):
            want = lib.encode(text, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, repr(text[:80])
            assert coder.decode(ids[a:b]) == lib.decode(want, skip_special_tokens=False)


def test_decode_of_any_ids():
    lib, coder, rnd = Tokenizer.from_file(PATH), automaton.Coder.of(PATH), random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert coder.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False)
    assert coder.decode(np.array([99_999_999, 64])) == "a"


def test_rows(spark):
    rows = [(1, "One two  three\n", "x"), (2, None, "x"), (3, "", "x"), (None, "same", "x"), (None, "same", "x"), (1, "<|endoftext|>!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(automaton.encode_decode(docs, with_ids=True).collect(), key=repr)
    lib = Tokenizer.from_file(PATH)
    want = []
    for doc, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(got[0].__class__(*r)))
    assert automaton.encode_decode(docs.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in automaton.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
