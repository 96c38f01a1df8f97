"""The pipeline's near-duplicate stage on null and repeated ids."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("graphloom.llm")


def test_dedup_rows(spark):
    import corpus_pipeline

    rng = random.Random(2)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    first = text(204)
    near = first[:200] + text(4)
    rows = [(1, " ".join(first)), (2, " ".join(near)), (3, "one id " + " ".join(text(60))), (3, "other text " + " ".join(text(60)))]
    rows += [(None, " ".join(text(60))), (None, " ".join(text(60))), (None, " ".join(first))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], *rows[2:6]], key=str)
