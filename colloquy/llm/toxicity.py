"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs over one word of the whole text are hashed into 2^20 buckets,
each present or not. FTRL-proximal keeps two numbers per bucket: the sum of its squared gradients,
which sets its own learning rate, and its accumulated gradient, which yields a weight only where
it exceeds the L1 strength. The weights that remain are a few thousand at most and travel to the
executors with the scoring function.

The fit reads at most `max_rows` labelled documents, those with the smallest hashes of their ids,
in one task, of a repeated id the row with the least features; scoring reads every whole text.

Defined results: a null or empty text has no features and gets the score of the bias alone; rows
are scored each for itself, repeated or not; without any label every score is 0.5; several labels
of an id count as the highest; an empty table gives an empty result; other columns are kept and a
column named `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import staged, text_of
from colloquy.llm.features import BITS, hashed, word_memo

MAX_ROWS = 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
EPOCHS = 4


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal with a rate per coordinate; the last coordinate is the bias, which L1 spares."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(size + 1), np.zeros(size + 1), size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == self.bias, 0, self.l1), 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = float(sigmoid(w.sum())) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def fit(self, rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> None:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.learn(rows[i], labels[i])


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_rows: int,
             id_col: str, text_col: str) -> DataFrame:
    """Rows (id, y, text) of at most max_rows ids: the labelled documents with the smallest hashes of their ids."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    )
    return (
        docs.select(F.col(id_col), text_of(text_col).alias("text"))
        .join(F.broadcast(staged(chosen, "labels")), id_col)  # max_rows rows of two numbers
    )


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic",
        max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            rows = [hashed(t, memo) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            rows += [np.array(v.values) for v in batch.column(1)]
        model = Ftrl(1 << BITS)
        model.fit(rows, y)
        w = model.weights(np.arange(model.bias + 1))
        at = np.union1d(np.flatnonzero(w), [model.bias])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["at", "w"])

    sample = labelled(docs, labels, label_col, usable, max_rows, id_col, text_col).select(
        F.col(id_col).cast("string").alias("id"), "y", "text")
    sample = sample.mapInArrow(featurise, "id string, y int, at array<int>")
    sample = staged(sample.groupBy("id").agg(F.min(F.struct("y", "at")).alias("row")).select(
        "id", "row.y", "row.at"), "toxic-features")
    weights = (
        sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "at").select("y", "at")
        .mapInArrow(train, "at long, w double").orderBy("at").toPandas()
    )
    at, w = weights["at"].to_numpy(np.int32), weights["w"].to_numpy()
    return at[:-1], w[:-1], float(w[-1]) if len(w) else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with `score`, between 0 and 1."""
    at, w, bias = model
    others = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(text_of(text_col).alias("__text__"), *[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*rows.schema[1:], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS)
        weight[at] = w
        memo = word_memo()
        for batch in batches:
            s = [float(sigmoid(bias + weight[hashed(t.as_py(), memo)].sum())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
