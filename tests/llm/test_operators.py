"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.llm import ann, crf, langid, licenses, mixing, ngramjoin, packing, syncmers, tokencount, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Row long, size string, bucket string"
SF = "/root/testdata/sf0.001"


def odd_rows():
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " ", "a", "x" * 50_000, long_text, long_text, "same words here again now", "same words here again now", "\u2581\U0001d518 <s> <|endoftext|>  \n\t", "two  blanks \n", "12 34 !!"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None, 1, "2", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", "en", "s0", 5, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_tokens(odd, none, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path())
    for table in (odd, docs):
        got = sorted(map(repr, tokencount.count_tokens(table).collect()))
        texts = table.select("doc_id", "text").collect()
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in texts]
        assert got == sorted(f"Row(doc_id={d}, n_bytes={b}, n_tokens={n}, over_limit={n > 4096})" for d, b, n in want)
    assert tokencount.count_tokens(none).count() == 0


def test_tokens_of_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path())
    draw = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\u2581", "==", "-", "\u00e9", "\u65e5", "\U0001d518", "1", "aa"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(800)] + ["a" * 700, " " * 40, "ab" * 300]
    assert tokencount.Counter.of(tokencount.model_path())(texts).tolist() == [len(model.encode(t)) for t in texts]


def test_nearest(spark):
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(900, 12)) * draw.uniform(0.5, 2, size=(900, 1))
    vectors[300:400] = vectors[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 12, 1), (1003, [float("nan")] * 12, 1), (1004, [None, *[1.0] * 11], 1), (1005, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (1020, [1.0] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.nearest(table, block_rows=300, chunk_rows=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = vectors.astype(np.float32).astype(float)
    hits = 0
    assert set(got) == {i for i in range(0, 900, 20)}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = (exact * exact[q]).sum(1)
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(table.where("vec_id < 0")).count() == 0
    assert ann.nearest(table.where("vec_id < 4")).count() == 3


@pytest.mark.parametrize("kind, dims", [("gaussian", 64), ("varied", 64), ("gaussian", 384), ("clustered", 128)])
def test_nearest_recall_in_full_blocks(spark, kind, dims):
    draw = np.random.default_rng(6)
    n = ann.BLOCK_ROWS + 100
    vectors = draw.normal(size=(n, dims))
    if kind == "varied":
        vectors *= np.exp(0.5 * draw.normal(size=(n, 1)))
    if kind == "clustered":
        vectors = draw.normal(size=(200, dims))[draw.integers(0, 200, n)] + 0.3 * vectors
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(vectors))}))
    got = {}
    for r in ann.nearest(table, every=300).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    assert len(got) == len(range(0, n, 300))
    for q, found in got.items():
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-score)[:20].tolist()))
        assert len(found) == 20 and all(abs(score[v] - s) < 1e-9 * abs(s) + 1e-9 for v, s in found.items())
    assert hits / (20 * len(got)) >= 0.95


def test_clustered_queries_visit_few_cells():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(64, 48)) * 3
    vectors = centres[draw.integers(0, 64, 20_000)] + 0.2 * draw.normal(size=(20_000, 48))
    vectors /= ann.lengths(vectors)[:, None]
    scale = ann.lengths(vectors).max()
    tree = ann.Cells.fit(vectors[:4000], scale, len(vectors), 500)
    p = ann.points(vectors, scale)
    cell = tree.of(p)
    assert np.bincount(cell).max() < 2500 and len(np.unique(cell)) > 30
    visited = 0
    at = ann.query_points(vectors[:50])
    for q in range(50):
        bound = np.sort(vectors @ vectors[q])[-20]
        width = ann.half_widths(np.array([bound]), vectors[q : q + 1], scale)[0]
        for c in np.unique(cell):
            own = p[cell == c]
            visited += ((at[q] + width >= own.min(0)) & (at[q] - width <= own.max(0))).sum() >= ann.COLLIDE * ann.PROJECTIONS
    assert visited / (50 * len(np.unique(cell))) < 0.6


def test_nearest_repeats_and_extremes(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (20, [1e-200, 0.0]), (40, [1e200, -1e200])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    # each of the three rows is a query, and meets the seven others
    assert sorted(x[0] for x in got[0]) == sorted([*range(1, 8)] * 3)
    assert sorted(x[1:] for x in got[0] if x[0] == 1) == [(2, 1e200), (2, 1e200), (2, 1e200)] or len({x[1] for x in got[0] if x[0] == 1}) <= 2
    assert sum(v == 0 for _, v, _ in got[0]) == 6
    assert sorted(x[0] for x in got[20]) == [*range(1, 8)] and {x[1] for x in got[20] if x[0] <= 2} == {2, 40}
    assert len(got[40]) == 7


def test_mixing(odd, none, docs):
    got = mixing.mix(docs).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = sorted(set(source.values()))
    total = {s: sum(n for d, n in size.items() if source[d] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * total[s]) for s in names) < 1.5 * sum(total.values()) else (low, level)
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["taken"] in (0, r["size"], 2 * r["size"])
        assert abs(r["target"] - min(low * weight[s], 2 * total[s])) < 1e-3
        taken[s] += r["taken"]
    for s in names:
        most = max(n for d, n in size.items() if source[d] == s)
        assert abs(taken[s] - min(low * weight[s], 2 * total[s])) <= most
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    small = mixing.copies(mixing.size_table(docs), cell=7).collect()
    assert len(small) == len(size)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixing.mix_documents(none).count() == 0


def test_pivot_keeps_words_and_expectation():
    draw = random.Random(1)
    for _ in range(200):
        p, q, a, b = draw.random(), draw.random(), draw.randrange(1, 90), draw.randrange(1, 90)
        mean = 0.0
        for u in np.linspace(0.0005, 0.9995, 1000):
            x, y = mixing.pivot(p, a, q, b, u)
            assert abs(x * a + y * b - p * a - q * b) < 1e-5 and (x in (0, 1) or y in (0, 1)) and 0 <= min(x, y) and max(x, y) <= 1
            mean += x / 1000
        assert abs(mean - p) < 5e-3


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), rest.split("/")[0])
    path = rest[len(rest.split("/")[0]) :]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "net", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/x", "http://example.net/de/", "http://xexample.com/de/1", "a://b.example.com/de/?q#x", "http://org?x=/fr/", "http://x.org/fr/", "http://x.org/fr", "http://a/b://c.net/", "http://\u00c4.net/x", "http://..net/", "http://u@h.net:80/"]
    table = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(3, urls[3], 2)], "page_id long, url string, host int")
    want = sorted(map(repr, [(i, *brute_url(u)) for i, u in enumerate(urls)] + [(3, *brute_url(urls[3]))]))
    assert sorted(repr(tuple(r)) for r in urlfilter.judge(table).collect()) == want
    assert sorted(repr(tuple(r)) for r in urlfilter.judge_by_join(table, urlfilter.RULES).collect()) == want
    assert urlfilter.judge(table.where("page_id < 0")).count() == 0


def test_licenses(odd, none, docs, spark):
    lines = [t for _, t in licenses.TEMPLATES]
    table = spark.createDataFrame([(i, f"intro\n{t}\nand more", 1) for i, t in enumerate(lines)] + [(90, "no licensed thing here at all", 1), (91, lines[0] + "\n" + lines[4], 1)], "doc_id long, text string, start int")
    got = licenses.scan(table).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["doc_id"] < 90} == {(i, n) for i, (n, _) in enumerate(licenses.TEMPLATES)}
    assert {r["license"] for r in got if r["doc_id"] == 91} == {licenses.TEMPLATES[0][0], licenses.TEMPLATES[4][0]}
    assert not [r for r in got if r["doc_id"] == 90]
    found = licenses.scan(docs).collect()
    want = [r["doc_id"] for r in docs.collect() for line in r["text"].split("\n") if line in lines]
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


@pytest.mark.parametrize("width", [60, 70, 80])
@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_wrapped_licenses(width, prefix):
    scanner = licenses.Scanner.own()
    for name, notice in licenses.TEMPLATES:
        lines = textwrap.wrap(notice, width)
        text = "\n".join(prefix + x for x in ["The parts of this file are of the author.", "", *lines, "", "and the rest of it is any other text"])
        got = scanner.scan(text)
        assert [(r[2], r[5]) for r in got] == [(name, 0)], (name, got)
        assert re.findall(r"\w+", text[got[0][0] : got[0][1]]) == re.findall(r"\w+", notice)
    clause = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the above notice."
    assert [r[2] for r in scanner.scan(clause)] == ["BSD-3-Clause"]


def test_short_license_beside_reworded_long_ones():
    long = [t.split() for _, t in licenses.TEMPLATES if len(t.split()) > 18]
    reworded = " ".join(w for t in long for i, w in enumerate(t) if i % 5 != 4)
    for name, notice in licenses.TEMPLATES:
        if len(notice.split()) <= 18:
            assert name in [r[2] for r in licenses.Scanner.own().scan(f"{reworded} {notice}")], name


def test_fingerprints(odd, none, docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in syncmers.fingerprint(docs.repartition(7)).collect()}
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (syncmers.anchors([x])[0] for x in (t, edited, following))
        assert r["fingerprint"] == syncmers.write(a) and r["edited_fingerprint"] == syncmers.write(b)
        assert r["near_edited"] == syncmers.likeness(a, b) and r["near_next"] == syncmers.likeness(a, c)
        assert syncmers.likeness(syncmers.read(r["fingerprint"]), b) == r["near_edited"]
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95
    strange = syncmers.fingerprint(odd).collect()
    assert len(strange) == odd.count() and all(0 <= r["near_next"] <= 1 for r in strange)
    assert syncmers.fingerprint(none).count() == 0
    alone = syncmers.fingerprint(odd.where("doc_id = 5")).collect()
    assert alone[0]["near_next"] == 1.0


def test_syncmers_are_context_free():
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh ") for _ in range(400))
    points = lambda t: {t[p : p + syncmers.K] for p in syncmers.anchors([t])[0][1].tolist()}
    inner = points(text[100:160])
    assert inner and all(x in text for x in inner)
    hashes = lambda t: set(syncmers.anchors([t])[0][0].tolist())
    assert hashes(text[100:160]) <= hashes("zzz" + text[100:160] + "yy")


def test_packing(odd, none, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    for table in (docs, odd):
        got = packing.pack_documents(table).collect()
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            head = len(ids) % 2048 or min(len(ids), 2048)
            cuts = [(0, head), *((s, 2048) for s in range(head, len(ids), 2048))]
            want += [(r["doc_id"], i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cuts)]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
        held = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in held.values():
            ends = list(itertools.accumulate(n for _, n in sorted(parts)))
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        assert len(held) <= 1.02 * sum(r["length"] for r in got) / 2048 + 2
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u3000", "x", "!", "é"])
def test_very_long_runs_are_encoded(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.MODEL)
    lib = Tokenizer.from_file(path)
    for text in ("word" + run * 2_000_000 + "word", run * 9_999 + "a" + run * 9_999, run * 10_001):
        assert packing.Encoder.of(path)([text])[0] == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bounded_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(9) == (2, 0)  # closes bin 1, the fullest
    assert bins.put(3) == (3, 0) or bins.open <= 2
    assert bins.open <= 2


def test_crf_equals_enumeration():
    draw = np.random.default_rng(4)
    k = 3
    for counts in ([1, 4, 2], [3, 1]):
        emission, transition, start = draw.normal(size=(sum(counts), k)), draw.normal(size=(k, k)), draw.normal(size=k)
        got, pairs, begun = crf.sweep(emission, np.array(counts), transition, start, pairs=True)
        want, want_pairs, at = np.zeros_like(emission), np.zeros((k, k)), 0
        for n in counts:
            weights = {p: np.exp(start[p[0]] + sum(emission[at + i, y] for i, y in enumerate(p)) + sum(transition[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(k), repeat=n)}
            total = sum(weights.values())
            for p, w in weights.items():
                for i, y in enumerate(p):
                    want[at + i, y] += w / total
                for a, b in itertools.pairwise(p):
                    want_pairs[a, b] += w / total
            at += n
        assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    long = [1, 64, 65, 200, 3000]
    emission = draw.normal(size=(sum(long), k))
    together = crf.sweep(emission, np.array(long), transition, start)[0]
    at = 0
    for n in long:
        forward = [start + emission[at]]
        for i in range(1, n):
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + transition, 0) + emission[at + i])
        last = np.exp(forward[-1] - np.logaddexp.reduce(forward[-1]))
        assert np.allclose(together[at + n - 1], last)
        at += n


def test_languages(spark, odd, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_documents(table)
    truth = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    got = langid.predict(table, model).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.97
    strange = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (11, "und")} <= strange
    assert langid.filter_languages(odd, model).columns == odd.columns
    assert langid.predict(none, None).count() == 0 and langid.fit_documents(none) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    english, german = (next(r["text"] for r in table.where(F.col("lang") == x).where("n_chars > 400").collect()) for x in ("en", "de"))
    tags = [y for _, y in langid.word_tags([english[:300] + " " + german[:300]], model)[0]]
    assert tags[3] == "en" and tags[-3] == "de"


def test_toxicity(spark, odd, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_tables(table, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = [r for r in toxicity.predict(held, model).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = np.array([r["predicted"] == truth[r["doc_id"]] for r in got])
    clean = np.array([r["predicted"] for r in got if not truth[r["doc_id"]]])
    assert right.mean() > 0.96 and clean.mean() < 0.02
    assert toxicity.predict(odd, model).count() == odd.count() and toxicity.predict(none, model).count() == 0
    assert toxicity.filter_toxic(odd, model).columns == odd.columns
    empty = labels.where("doc_id < 0")
    assert {r["score"] for r in toxicity.predict(odd, toxicity.fit_tables(table, empty)).collect()} == {0.0}
    text = spark.createDataFrame([(1, "the idiot of them"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"], r["stop"], r["span"]) for r in toxicity.spans(text, model).collect()] == [(1, 4, 9, "idiot")]


def test_toxic_words_of_a_small_language():
    draw = random.Random(5)
    common = [f"wo{draw.randrange(10**6)}" for _ in range(400)]
    other = [f"zu{draw.randrange(10**6)}" for _ in range(400)]
    fill = lambda words: [draw.choice(words) for _ in range(30)]
    rows = [(1, " ".join([*fill(common), draw.choice(("idiot", "scum"))])) for _ in range(480)] + [(0, " ".join(fill(common))) for _ in range(480)]
    rows += [(1, " ".join([*fill(other), "bomente" + draw.choice(("bo", "co", "ga", "ja", "ra", "ta"))])) for _ in range(20)] + [(0, " ".join(fill(other))) for _ in range(20)]
    toxic = toxicity.toxic_words([(y, set(text.split())) for y, text in rows])
    planted = {w for _, text in rows for w in text.split() if w.startswith("bomente")} | {"idiot", "scum"}
    assert planted <= toxic and len(toxic - planted) <= 3
    model = toxicity.train(rows, 0.1)
    assert not model.tagger.lexicon
    # a word of the stem that no document had
    marginal, _ = crf.tag(crf.Words(model.tagger), [" ".join(other[:20]) + " bomentexi", " ".join(other[:21])])
    assert marginal[20, 1] > 0.5 and np.delete(marginal[:, 1], 20).max() < 0.5


def test_context_makes_a_word_toxic():
    draw = random.Random(8)
    common = [f"wo{draw.randrange(10**6)}" for _ in range(300)]
    fill = lambda n: [draw.choice(common) for _ in range(n)]
    rows = []
    for _ in range(400):  # "pig" is toxic after "filthy", and not after "guinea"
        rows.append((1, " ".join([*fill(12), "filthy", "pig", *fill(12)])))
        rows.append((0, " ".join([*fill(12), "guinea", "pig", *fill(6), "filthy", "floor", *fill(6)])))
    model = toxicity.train(rows, 0.5)
    both = lambda a, b: crf.tag(crf.Words(model.tagger), [" ".join([*common[:8], a, b, *common[8:16]])])[0][8:10, 1]
    assert both("filthy", "pig").max() > 0.5
    assert both("guinea", "pig").max() < 0.5 and both("filthy", "floor").max() < 0.5


def test_bag_gradient_is_of_the_likelihood():
    draw = np.random.default_rng(3)
    words = [[f"a{draw.integers(9)}" for _ in range(n)] for n in (3, 70, 1, 5)]
    none = crf.fit_bags(words, np.array([True, False, True, False]), [np.zeros(len(w), int) for w in words], steps=0)
    e = draw.normal(size=(79, 2))
    counts = np.array([3, 70, 1, 5])
    stay = np.empty(79)
    crf.sweep(e, counts, none.transition, none.start, stay=stay)
    at = 0
    for n in counts:
        forward = none.start + e[at]
        zero = none.start[0] + e[at, 0]
        for i in range(1, n):
            forward = np.logaddexp.reduce(forward[:, None] + none.transition, 0) + e[at + i]
            zero += none.transition[0, 0] + e[at + i, 0]
        assert np.isclose(np.log(stay[at : at + n]).sum(), zero - np.logaddexp.reduce(forward))
        at += n


def test_training_takes_stretches_of_very_long_texts(spark):
    long_ = " ".join(f"w{i}" for i in range(900_000))
    rows = [(i, long_ + (" scum" * 400_000 if i % 2 else ""), "en") for i in range(1, 5)] + [(i, "some scum here" if i % 2 else "some words here", "en") for i in range(5, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, _ = toxicity.sample(table, table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    sizes = [len(r["part"]) for r in found.collect()]
    assert max(sizes) <= toxicity.STRETCHES * (toxicity.STRETCH + 1)
    assert all(len(r["part"]) <= langid.STRETCHES * (langid.STRETCH + 1) for r in langid.sample(table).collect())
    whole = spark.createDataFrame([(1, "a few words"), (2, None), (3, "")], "doc_id long, text string")
    from sievemill.llm.common import windows

    assert [r[0] for r in whole.orderBy("doc_id").select(windows("text", F.col("doc_id"), 100, 2)).collect()] == ["a few words", None, ""]


def test_toxicity_by_language(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = toxicity.predict(held, toxicity.fit_tables(table, labels)).join(labels.where("toxic = 1"), "doc_id").join(held.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        assert np.mean([r["predicted"] for r in got if r["lang"] == lang]) >= 0.8, lang


def brute_components(rows, n, t):
    sets, parent = [], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and t.denominator * len(a & b) >= t.numerator * len(a | b):
            parent[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(repr((rows[i][0], len(sets[i]), least[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("n, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_near_duplicates(spark, odd, none, docs, n, t):
    draw = random.Random(7)
    base = [f"w{draw.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(120):  # a cluster whose members differ from each other more than from the first
        words = list(base)
        for _ in range(draw.randrange(0, 6)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((500 - i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{draw.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), odd, docs):
        data = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = ngramjoin.near_duplicates(table, n, t)
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute_components(data, n, t)
    assert ngramjoin.near_duplicates(none, n, t).count() == 0
    kept = ngramjoin.keep_one(odd, n, t)
    assert kept.columns == odd.columns
    wordless = odd.where("text is null or trim(text) = ''").count()
    linked = {x for x in brute_components([(r["doc_id"], r["text"]) for r in odd.collect()], n, t)}
    assert kept.where("text is null or trim(text) = ''").count() == wordless and kept.count() <= odd.count() and linked


def test_long_lists_meet_by_blocks(spark):
    rows = spark.range(30).select(F.lit(5).cast("long").alias("token"), F.col("id").alias("group"), F.lit(3).cast("long").alias("size"), F.lit(0).cast("long").alias("place"), F.col("id").alias("label"), F.col("id").alias("other"))
    one = ngramjoin._in_lists(ngramjoin._lists(rows), Fraction(1, 100))
    many = ngramjoin._in_lists(ngramjoin._lists(rows, most=4), Fraction(1, 100))
    assert one.count() == many.count() == 30 * 29 // 2


def test_shared_postings_over_batches(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(40), draw.randrange(30), 1 << ngramjoin._PLACE_BITS, None) for _ in range(300)] + [(7, 9, -3, b"m")] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ngramjoin._shared(spark.createDataFrame(rows, ngramjoin._SECOND)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, g, m, _ in rows:
        if m >= 0:
            groups.setdefault(k, set()).add(g)
    assert sorted((r["key"], r["group"]) for r in got if r["meta"] >= 0) == sorted((k, g) for k, gs in groups.items() if len(gs) > 1 for g in gs)
    assert sum(r["meta"] < 0 for r in got) == 2


def test_groups_are_paired_before_members(spark, monkeypatch):
    """80 near copies whose rarest shingles agree are one group, so one pair of groups stands for all their pairs."""
    draw = random.Random(11)
    hubs = []
    made = ngramjoin._filtered
    monkeypatch.setattr(ngramjoin, "_filtered", lambda pairs, groups, t: (hubs.append((pairs.count(), groups.count())), made(pairs, groups, t))[1])
    rare = [f"r{draw.randrange(10**6)}" for _ in range(120)]
    common = [f"c{draw.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(common)) for i in range(1000, 1300)]
    for i in range(80):
        tail = list(common)
        tail[draw.randrange(50)] = common[draw.randrange(60)]
        rows.append((i, " ".join(rare + tail)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngramjoin.near_duplicates(table, 3, Fraction(4, 5))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_components(rows, 3, Fraction(4, 5))
    assert hubs[0][0] < 80


def test_prefixes_share_enough():
    draw = random.Random(13)
    for t in (Fraction(4, 5), Fraction(9, 10), Fraction(1, 2), Fraction(1, 3)):
        for _ in range(3000):
            base = draw.sample(range(400), draw.randrange(1, 60))
            x, y = set(base), set(base)
            for s in (x, y):
                for _ in range(draw.randrange(0, 9)):
                    s.symmetric_difference_update({draw.randrange(400)})
            if not x or not y or len(x & y) < t * len(x | y):
                continue
            n = [ngramjoin._prefix_length(len(s), t) for s in (x, y)]
            k = [ngramjoin._common(len(s), t) for s in (x, y)]
            assert set(sorted(x)[: n[0]]) & set(sorted(y)[: n[1]])
            both = set(sorted(x)[: n[0] + k[0] - 1]) & set(sorted(y)[: n[1] + k[1] - 1])
            assert len(both) >= min(k) and min(k) >= ngramjoin._common(-(-t.numerator * len(x) // t.denominator), t)


def test_full_store_starts_anew(monkeypatch):
    rows = [("a", "red green blue word " * 8), ("b", "rot gruen blau wort " * 8)]
    model = langid.train(rows)
    texts = [f"red w{i} blau x{i}" for i in range(200)]
    want = crf.tag(crf.Words(model), texts)[0]
    monkeypatch.setattr(crf, "STORE", 30)
    words = crf.Words(model)
    got = np.concatenate([crf.tag(words, texts[i : i + 10])[0] for i in range(0, 200, 10)])
    assert np.allclose(got, want)
    path = tokencount.model_path()
    counter = tokencount.Counter(path)
    monkeypatch.setattr(tokencount, "STORE", 30)
    whole = tokencount.Counter.of(path)(texts)
    assert [int(n) for i in range(0, 200, 10) for n in counter(texts[i : i + 10])] == whole.tolist()
