"""Groups, links and counts against a plain alignment of whole texts by the two libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievemill.llm import alignment, automaton
from sievemill.llm.packing import _byte_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(libs, text):
    """n_a, n_b, groups as text, and all links of a text."""
    a, b = libs
    if not text:
        return 0, 0, [], []
    byte_of, want = _byte_of(), (" " + text).encode()
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return 0, 0, [], []

    def spans(tokens):
        at = 0
        for i, x in tokens:
            yield i, at, at + len(x)
            at += len(x)

    left, right = list(spans(left)), list(spans(right))
    cuts = {e for _, _, e in left} & {e for _, _, e in right}
    groups = []
    lo = 0
    for cut in sorted(cuts):
        x, y = ([i for i, s, e in side if s >= lo and e <= cut] for side in (left, right))
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        lo = cut
    pairs = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e] if len(left) < 400 else None
    if pairs is None:
        pairs, at = [], 0
        for i, s, e in left:
            while right[at][2] <= s:
                at += 1
            k = at
            while k < len(right) and right[k][1] < e:
                pairs.append((i, right[k][0]))
                k += 1
    return len(left), len(right), groups, pairs


def expected(libs, rows):
    found = [(doc, *whole(libs, text)) for doc, text in rows]
    count = Counter(p for *_, pairs in found for p in set(pairs))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted((doc if doc is not None else -1, n_a, n_b, len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, pairs in found)


def given(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


ODD = ["the", " of", " word", "x", " ", "  ", "\n", "\n\n", "\t", "é", "ß", " 1", "23", "!", "...", "<|endoftext|>", " <s>", "▁", "　", "日", "本", "\U0001f600", "\xa0", "\r\n", "ing", "ÃÂ", "\0", "\x1c", "ﬁ", "é"]


def test_odd_texts(spark, libs, monkeypatch):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(700)]
    texts += [None, "", " ", "\n", "foo ", " foo", "  foo  bar", "a\n b", "x" * 3000, "again and again", "again and again", "ab " * 4000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, key string")
    assert given(alignment.align(df.repartition(3))) == expected(libs, rows)
    assert alignment.align(df.limit(0)).collect() == []


def test_small_stores_and_blocks(libs, monkeypatch):
    """Units are the same whether a worker has kept them or not."""
    monkeypatch.setattr(alignment, "STORE_CHARS", 400)
    rnd = random.Random(2)
    aligner = alignment.Aligner(A, B)
    for _ in range(60):
        texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(10)]
        for text, units in zip(texts, aligner.numbers(texts), strict=True):
            got = ";".join(aligner.unit_text[i] for i in units.tolist())
            assert got == ";".join(whole(libs, text)[2])


def test_links():
    assert alignment.links([3, 2], [1, 4]) == [(0, 0), (0, 1), (1, 1)]
    assert alignment.links([5], [2, 3]) == [(0, 0), (0, 1)]


def test_specials_are_text(libs):
    coder = automaton.Coder(A, specials=False)
    text = "a<|endoftext|> b"
    assert coder.encode([text])[0].tolist() == libs[0].encode(text, add_special_tokens=False).ids


def test_query(spark, libs):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert given(alignment.query(spark, sf)) == expected(libs, rows)
