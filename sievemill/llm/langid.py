"""Language of whole texts by a linear-chain conditional random field over their words.

Every blank-separated word with a letter is tagged by forward-backward with affix, n-gram and lexicon
features and learned transitions, so a text may switch language; its marginals, summed over the text,
give the text's language and score.

Defined results: a null text and one without a letter give ``und`` with score 0; texts of any length are
judged whole; of languages with the same mass the first by name wins; equal texts give equal rows;
repeated rows stay; an empty table gives an empty result; other columns are ignored (or kept by
:func:`filter_languages`).  A table without labelled rows makes every text ``und``.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import crc_mod, fitted, hash_bucket, held, map_slices, table, windows

#: Bounds of the labelled sample that the model learns from.
DOCS_PER_LANGUAGE, SNIPPET = 300, 20
#: A sampled document longer than so many stretches of so many characters is learned from at such hash-placed stretches.
STRETCHES, STRETCH = 3, 300
#: A word in so many of a language's sampled documents, and this share of all that have it, is in its lexicon.
LEXICON_DOCS, LEXICON_SHARE = 5, 0.8
HELD_OUT = (4, 2)
UNKNOWN = "und"


def learnable() -> Column:
    """Rows whose label may be learned from."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod("doc_id", HELD_OUT[0]) != HELD_OUT[1], F.lit(False))


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame | None:
    """(lang, at, doc_id, text) of about ``per_language`` documents of each language or fewer, chosen by a hash of the id."""
    known = docs.where(learnable()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    bucket = hash_bucket("doc_id")
    chance = F.lit(False)
    for lang, n in sizes.items():
        chance = chance | ((F.col("lang") == lang) & (bucket < min(1_000_000, 1 + int(1_500_000 * per_language / n))))
    # Repeated ids share a bucket, so each id gives one text: the rows stay within about 1.5 times the bound.
    part = windows("text", F.col("doc_id"), STRETCH, STRETCHES)
    return known.where(chance).groupBy("doc_id", "lang").agg(F.min(part).alias("part"), F.first(bucket).alias("at")).select("lang", "at", "doc_id", "part")


def _chosen(rows: list[tuple], per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for lang in sorted({r[0] for r in rows}):
        out += [(lang, text) for _, _, _, text in sorted(r for r in rows if r[0] == lang)[:per_language]]
    return out


def train(rows: list[tuple[str, str]], seed: int = 5) -> crf.Model | None:
    """The tagger; its sequences chain snippets of one to four documents, so that it learns switches too."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    number = {lang: i for i, lang in enumerate(labels)}
    texts = [(number[lang], [w for w in map(crf.normal, text.split()) if w]) for lang, text in rows]
    index: dict[str, int] = {}
    held_in = [(y, np.fromiter((index.setdefault(w, len(index)) for w in set(words)), np.int32)) for y, words in texts]
    seen = np.zeros((len(index), len(labels)))
    for y, at in held_in:
        seen[at, y] += 1
    sums, most = seen.sum(1), seen.max(1, initial=0)
    sure = (sums >= LEXICON_DOCS) & (most >= LEXICON_SHARE * sums)
    lexicon = {w: int(seen[i].argmax()) for w, i in index.items() if sure[i]}
    del index, held_in, seen
    draw = random.Random(seed)
    snippets = [(y, words[i : i + SNIPPET]) for y, words in texts for i in range(0, len(words), SNIPPET)]
    draw.shuffle(snippets)
    sequences, tags = [], []
    while snippets:
        part = [snippets.pop() for _ in range(min(len(snippets), draw.choice((1, 2, 2, 3, 4))))]
        sequences.append([w for _, words in part for w in words])
        tags.append(np.concatenate([np.full(len(words), y) for y, words in part]))
    return crf.fit(sequences, tags, labels, lexicon) if sequences else None


def fit_documents(docs: DataFrame) -> crf.Model | None:
    rows = sample(docs)
    return None if rows is None else fitted(rows, lambda found: train(_chosen(found)))


def _judge(words: crf.Words | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, its mean marginal, and the mean of each word's largest marginal."""
    if words is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    marginal, counts = crf.tag(words, texts)
    mass = crf.by_text(marginal, counts)
    best = mass.argmax(1)
    each = np.maximum(counts, 1)
    score = np.where(counts > 0, mass.max(1) / each, 0.0)
    sure = crf.by_text(marginal.max(1), counts) / each
    return [words.model.labels[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)], np.clip(score, 0.0, 1.0), sure


class Judge:
    """A broadcast model and, in each worker, its store of scored words."""

    def __init__(self, spark: SparkSession, model: crf.Model | None):
        self.sent = spark.sparkContext.broadcast(model)

    def words(self) -> crf.Words | None:
        model = self.sent.value
        return None if model is None else held(model, crf.Words)


def predict(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    judge = Judge(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, _ = _judge(judge.words(), batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out")
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), run, "doc_id long, held_out boolean, lang_pred string, score double", size=crf.TAGGED)


def word_tags(texts: list[str | None], model: crf.Model) -> list[list[tuple[str, str]]]:
    """Each word with its likeliest label: where a text switches language."""
    marginal, counts = crf.tag(crf.Words(model), texts)
    out, at = [], 0
    for text, n in zip(texts, counts, strict=True):
        words = [w for w in (text or "").split() if crf.normal(w)]
        out.append([(w, model.labels[j]) for w, j in zip(words, marginal[at : at + n].argmax(1), strict=True)])
        at += n
    return out


def filter_languages(docs: DataFrame, model: crf.Model | None, min_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and whose words are of learned languages.

    A word's largest marginal says how surely it is of one; their mean must be ``min_score`` or more.  So a text
    that switches between learned languages stays.
    """
    judge = Judge(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, _, sure = _judge(judge.words(), batch.column("text").to_pylist())
        keep = [lang != UNKNOWN and s >= min_score for lang, s in zip(langs, sure, strict=True)]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_slices(docs, run, docs.schema, size=crf.TAGGED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_documents(docs))
