"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of `documents`. Quality and packing read whole texts in one pass; the
de-duplicating stages keep one row of each group; sanitising replaces spans in place.

A stage's result is to be written before the next stage begins: then the tables that it staged on the
way are deleted, but for those that the next stage's docs read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import exact_dedup, packing, pii, quality, simhash
from colloquy.llm.common import release, staged, staging
from colloquy.llm.queries import tokenizer_file


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_finished: list[str] = []  # what earlier stages staged


def frees_scratch(stage: Stage) -> Stage:
    """The stage, after the tables that earlier ones staged are deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, _finished)
        with staging() as paths:
            out = stage(spark, docs, sf_dir)
        _finished.extend(paths)
        return out

    return run_stage


@frees_scratch
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("kept").select(docs.columns)


@frees_scratch
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


@frees_scratch
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # On sf0.1, fingerprints of texts with a five-word similarity of 0.8 differ in 2 to 11 bits.
    return simhash.kept_documents(docs, distance=11, similarity=0.8)


@frees_scratch
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


@frees_scratch
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

# Hashes, tokens and trained models are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs: list[str] = []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with staging() as paths:
            docs = staged(result, name.replace(" ", "-"))
        release(docs, outputs)
        outputs += paths
    return STAGES[-1][1](spark, docs, sf_dir)
