"""Toxicity of whole texts by a linear-chain conditional random field that tags toxic words.

Token labels are learned from document labels.  Words and stems that labelled-toxic documents have beyond
chance seed them; then the CRF, whose features are n-grams and affixes of a word and of its neighbours and
no word list, is trained on what is known of the tags: a clean document has no toxic one, a toxic document
has one at least (:func:`crf.fit_bags`).  Forward-backward marginals are aggregated per document, and a
logistic curve maps them to a score.

Defined results: null, empty and letterless texts are scored like texts without a toxic word; whole texts
of any length are tagged; equal texts score alike; repeated rows stay; an empty table gives an empty
result; without labels of both kinds every score is the share of toxic labels (0 if there are none);
other columns are ignored (or kept by :func:`filter_toxic`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import crc_mod, fitted, hash_bucket, held, map_slices, table, windows

#: Labelled documents of each kind that the model learns from at most.
DOCS_PER_KIND = 900
#: A sampled document longer than so many stretches of so many characters is learned from at such hash-placed stretches.
STRETCHES, STRETCH = 4, 1000
#: A word or a stem of so many letters tells if so many toxic documents that nothing else explains have it, its odds
#: are so high, and by chance no more than CHANCE of all that were looked at would do as well.
LEAST_DOCS, STEM, LEAST_ODDS, CHANCE = 4, 4, 4.0, 1.0
HELD_OUT = (5, 0)


@dataclass
class Model:
    tagger: crf.Model | None
    curve: np.ndarray
    base: float


def sample(docs: DataFrame, labels: DataFrame, per_kind: int = DOCS_PER_KIND) -> tuple[DataFrame | None, float]:
    """(toxic, id, text) of at most ``per_kind`` documents of each label, chosen by a hash of the id, and the share of toxic labels."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.coalesce(crc_mod("doc_id", HELD_OUT[0]) != HELD_OUT[1], F.lit(False))).select(F.col("doc_id").alias("id"), "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return None, 0.0
    bucket = hash_bucket("id")
    chance = F.lit(False)
    for toxic, n in sizes.items():
        chance = chance | ((F.col("toxic") == toxic) & (bucket < min(1_000_000, 1 + int(1_500_000 * per_kind / n))))
    rows = known.where(chance).groupBy("id", "toxic").agg(F.first(bucket).alias("at")).collect()
    chosen = [r for toxic in sorted(sizes) for r in sorted((r for r in rows if r["toxic"] == toxic), key=lambda r: (r["at"], r["id"]))[:per_kind]]
    ids = docs.sparkSession.createDataFrame([(r["id"], r["toxic"]) for r in chosen], "id long, toxic int")
    part = F.coalesce(windows("text", F.col("doc_id"), STRETCH, STRETCHES), F.lit(""))
    picked = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "toxic", part.alias("part")).groupBy("id", "toxic").agg(F.min("part").alias("part"))
    return picked.select("toxic", "id", "part"), sizes.get(1, 0) / sum(sizes.values())


def _summary(marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
    toxic = marginal[:, 1]
    mass, top = crf.by_text(toxic, counts), crf.by_text(toxic, counts, np.maximum)
    return np.stack([np.ones(len(counts)), np.log1p(mass), top, np.minimum(1, 25 * mass / np.maximum(counts, 20))], 1)


def _by_chance(clean: int, toxic: int, share: float) -> float:
    """Chance that of clean + toxic documents so many or more are toxic."""
    n = clean + toxic
    return sum(math.comb(n, j) * share ** (n - j) * (1 - share) ** j for j in range(clean + 1))


def toxic_words(texts: list[tuple[int, set[str]]]) -> set[str]:
    """Words of toxic documents that tell, or have a stem that does.

    Found in rounds: what the words found so far explain no longer counts, so that the words of a few documents in one
    language need not stand out among the toxic documents of all languages.
    """
    stems = lambda w: (w[:n] for n in range(min(STEM, len(w)), len(w) + 1))
    often: dict[str, int] = {}
    for y, words in texts:
        if y:
            for s in {s for w in words for s in stems(w)}:
                often[s] = often.get(s, 0) + 1
    have: dict[str, set[int]] = {s: set() for s, n in often.items() if n >= LEAST_DOCS}
    del often
    for i, (y, words) in enumerate(texts):
        if y:
            for s in {s for w in words for s in stems(w) if s in have}:
                have[s].add(i)
    clean = dict.fromkeys(have, 0)
    own: dict[str, int] = {}
    for y, words in texts:
        if not y:
            for s in {s for w in words for s in stems(w) if s in clean}:
                clean[s] += 1
            for w in words:
                own[w] = own.get(w, 0) + 1
    left = {i for i, (y, _) in enumerate(texts) if y}
    n_toxic, n_clean = len(left), len(texts) - len(left)
    odds = lambda t, c: ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    open_ = {s for s, docs in have.items() if odds(len(docs), clean[s]) >= LEAST_ODDS}
    telling: set[str] = set()
    while left:
        share = len(left) / (len(left) + n_clean)
        found = {s for s in open_ if len(now := have[s] & left) >= LEAST_DOCS and _by_chance(clean[s], len(now), share) * len(have) <= CHANCE}
        if not found:
            break
        telling |= found
        open_ -= found
        left = left.difference(*(have[s] for s in found))
    counts: dict[str, int] = {}
    for y, words in texts:
        if y:
            for w in words:
                if any(s in telling for s in stems(w)):
                    counts[w] = counts.get(w, 0) + 1
    return {w for w, n in counts.items() if odds(n, own.get(w, 0)) >= LEAST_ODDS / 4}


def train(rows: list[tuple[int, str]], share: float) -> Model:
    kinds = [sum(y == k for y, _ in rows) for k in (0, 1)]
    nothing = Model(None, np.zeros(4), share)
    if not all(kinds):
        return nothing
    pool: dict[str, str] = {}
    texts = [(y, [pool.setdefault(w, w) for w in map(crf.normal, t.split()) if w]) for y, t in rows]
    del pool
    toxic = toxic_words([(y, set(words)) for y, words in texts])
    full = [(y, words) for y, words in texts if words]
    sequences = [words for _, words in full]
    seeds = [np.fromiter((y == 1 and w in toxic for w in words), np.int64, len(words)) for y, words in full]
    if not any(y for y, _ in full) or all(y for y, _ in full):
        return nothing
    tagger = crf.fit_bags(sequences, np.array([y == 1 for y, _ in full]), seeds)
    words, parts = crf.Words(tagger), [t for _, t in rows]
    tagged = [_summary(*crf.tag(words, parts[i : i + 256])) for i in range(0, len(parts), 256)]
    x, y = np.concatenate(tagged), np.array([k for k, _ in rows], float)
    weight = np.where(y == 1, share / kinds[1], (1 - share) / kinds[0]) * len(y)
    curve = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(curve)), x.T @ (weight * (y - p)) - 1e-2 * curve)
        curve = curve + np.clip(step, -4, 4)
    return Model(tagger, curve, share)


def fit_tables(docs: DataFrame, labels: DataFrame) -> Model:
    rows, share = sample(docs, labels)
    none = Model(None, np.zeros(4), share)
    if rows is None:
        return none
    return fitted(rows, lambda found: train([(y, t) for y, _, t in sorted(found)], share)) or none


class Judge:
    def __init__(self, spark: SparkSession, model: Model):
        self.sent = spark.sparkContext.broadcast(model)

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return crf.tag(held(self.sent.value.tagger, crf.Words), texts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        model = self.sent.value
        if model.tagger is None:
            return np.full(len(texts), model.base)
        return 1 / (1 + np.exp(-np.clip(_summary(*self.tag(texts)) @ model.curve, -30, 30)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    judge = Judge(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = judge.score(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out")
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), run, "doc_id long, held_out boolean, score double, predicted int", size=crf.TAGGED)


def spans(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, stop (code points), text and marginal of every toxic stretch of words."""
    judge = Judge(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids, out = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), []
        if judge.sent.value.tagger is not None:
            marginal, counts = judge.tag(texts)
            at = 0
            for doc, text, n in zip(ids, texts, counts, strict=True):
                p = marginal[at : at + n, 1]
                at += n
                if not n or p.max() < threshold:
                    continue
                place, run_ = 0, None
                words = [w for w in text.split() if crf.normal(w)]
                for w, q in zip(words, p, strict=True):
                    begin = text.index(w, place)
                    place = begin + len(w)
                    if q >= threshold:
                        run_ = (run_[0], place, max(run_[2], q)) if run_ else (begin, place, q)
                    elif run_:
                        out.append((doc, *run_[:2], text[run_[0] : run_[1]], float(run_[2])))
                        run_ = None
                if run_:
                    out.append((doc, *run_[:2], text[run_[0] : run_[1]], float(run_[2])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "start", "stop", "span", "marginal"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, start long, stop long, span string, marginal double", size=crf.TAGGED)


def filter_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below ``threshold``."""
    judge = Judge(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge.score(batch.column("text").to_pylist()) < threshold))

    return map_slices(docs, run, docs.schema, size=crf.TAGGED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_tables(docs, table(spark, sf_dir, "labels")))
