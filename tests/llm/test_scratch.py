"""Staged tables of finished stages are deleted, those that are still read stay."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm.common import release, staged, staging


def test_release_keeps_what_is_read(spark):
    with staging() as paths:
        a = staged(spark.range(5).withColumn("x", F.lit(1)), "a")
        staged(spark.range(5), "b")
    held = list(paths)
    release(a, paths)
    assert paths == held[:1] and Path(held[0]).exists() and not Path(held[1]).exists()
    assert a.count() == 5


def test_stages_free_what_earlier_ones_staged(spark, tmp_path):
    rows = [(i, f"Some text number {i % 7} stands here, and more of it.", "en", "s", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lazy = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
    near = corpus_pipeline.drop_near_copies(spark, lazy, str(tmp_path))  # its docs still read what was staged
    assert near.count() == 7
    near.write.parquet(f"{tmp_path}/near")
    before = list(corpus_pipeline._finished)
    corpus_pipeline.sanitise(spark, spark.read.parquet(f"{tmp_path}/near"), str(tmp_path))
    assert before and not any(Path(p).exists() for p in before)
