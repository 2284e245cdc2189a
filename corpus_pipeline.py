"""From raw documents to packed training sequences, in five stages over the ``documents`` table.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm import langid, mixing, ngramjoin, packing, toxicity
from sievemill.llm.common import materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.  Learned from labelled rows of the raw table."""
    model = toxicity.fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words agree on no learned language, go."""
    return langid.filter_languages(docs, langid.fit_documents(table(spark, sf_dir, "documents")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return ngramjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_copies", drop_near_copies), ("mix", mix_sources), ("pack", pack_sequences)]

#: No stage before the last is expressible in SQL; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for _, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
