"""The pipeline's stages on a small table."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sievemill.llm import crf
from sievemill.llm.common import materialize, small_batches

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "mix", "pack"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        if name != "pack":
            assert out.columns == columns
        if name in ("toxicity", "language", "near_copies"):
            assert before * 0.7 <= out.count() <= before
            assert out.select("doc_id").distinct().count() == out.count()
        before, docs = out.count(), out
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_words_are_scored_in_little_room():
    """A worker that meets many new words at once needs no room for all their features, and scores them as one by one."""
    model = crf.Model([0, 1], np.random.default_rng(3).normal(size=(1 << crf.BITS, 6)).astype(np.float32), np.zeros((2, 2)), np.zeros(2), {})
    words = [f"wort{i * 7919 % 1_000_003}ende" for i in range(20_000)]
    tracemalloc.start()
    got = model.emissions(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert np.array_equal(got[::1999], np.concatenate([model.emissions([w]) for w in words[::1999]]))
    assert model.emissions([]).shape == (0, 6)


def test_batches_are_small_only_while_stages_run(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 50):
        sizes = spark.range(0, 400, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in bs), "id long").collect()
        assert max(r["id"] for r in sizes) == 50
    assert spark.conf.get(name) == before
