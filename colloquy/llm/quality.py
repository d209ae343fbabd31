"""Quality classification by co-training two views of a document.

The content view describes the whole text by shares: letters' case, digits, symbols, repeated
words and lines, word lengths. The metadata view knows language, source, length and line layout.
Each view has a logistic regression. In every round each view scores the whole unlabelled table and
hands the documents that it is surest about to the other for training. On labelled documents kept
aside, both views' scores are calibrated and combined; every document is scored by the result.

All documents are turned into features once, some sixty numbers each, in a staged table. The driver
holds the labelled ones, at most `max_rows` with the smallest hashes of their ids, of a repeated id the
row with the least features. The unlabelled ones, all of them, stay in Spark: which pseudo-label a
document has follows from the rounds' models and cutoffs, so tasks work it out anew, and only
gradient and Hessian sums per view and class, and a histogram of the scores, reach the driver.
A cutoff is an edge of the histogram, 1/64 wide in log odds: at least the round's quota is taken.

Defined results: a null text is empty; an empty text has zero shares; null languages and sources
are values of their own, null lengths are taken from the text; rows are scored each for itself,
repeated or not, and take part in training likewise where unlabelled; several labels of an id count as the lowest; without labels of both classes every
score is 0.5 and every document is kept; an empty table gives an empty result; other columns are
kept, clashing names (`score`, `content_score`, `metadata_score`, `kept`) are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import staged, text_of

MAX_ROWS = 20_000
ROUNDS = 5
STEPS = 12  # Newton steps a round at most; each round begins at zero, where Newton's method is safe
BINS, LIMIT = 64, 35  # of the histogram: to a unit of log odds, and its range
SURE = 0.95
THRESHOLD = 0.5
SOURCE_BUCKETS, LANGUAGE_BUCKETS = 32, 8
OUT = ("content_score", "metadata_score", "score", "kept")


def content(text: str) -> list[float]:
    """Shares that describe the whole text."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words, n = text.split(), max(1, int(raw.sum()))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()))
    lines = text.split("\n")
    m = max(1, len(words))
    p = raw[raw > 0] / n
    plain = int(raw[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    symbols = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) - plain
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        float(raw[65:91].sum()) / letters, float(raw[48:58].sum()) / n, plain / n, symbols / n,
        float(raw[33]) / m, float(raw[124]) / m, float(raw[10]) / m, again / m,
        len(set(words)) / m, np.log1p(m) * len(set(words)) / m, len(set(lines)) / len(lines),
        sum(map(len, words)) / m / 10, float(-(p * np.log2(p)).sum()) / 8,
        float(raw[46]) / m, sum(map(str.isupper, words)) / m, sum(map(str.islower, words)) / m,
        float(raw[60] + raw[62] + raw[123] + raw[125]) / n, float(raw[47] + raw[92]) / m,
    ]


def metadata(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known about the page: language, source, length and line layout."""
    lines = text.count("\n") + 1
    size = len(text) if n_chars is None else max(0, n_chars)
    out = [np.log1p(size) / 10, np.log1p(size) ** 2 / 100, np.log1p(lines) / 5, np.log1p(size / lines) / 5]
    for value, n in ((lang, LANGUAGE_BUCKETS), (source, SOURCE_BUCKETS)):
        hot = [0.0] * (n + 1)
        hot[n if value is None else zlib.crc32(value.encode()) % n] = 1.0
        out += hot
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """Logistic regression on standardised features, by Newton steps with an L2 penalty."""

    def __init__(self, x: np.ndarray, l2: float = 1.0):
        """Standardises by x, predicts nothing yet."""
        self.mean, self.scale, self.l2 = x.mean(0), x.std(0), l2
        self.scale[self.scale < 1e-9] = 1.0
        self.beta = np.zeros(x.shape[1] + 1)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def sums(self, x: np.ndarray, y: int | np.ndarray) -> np.ndarray:
        """The number of rows, their gradient and their Hessian, as one row of numbers that add up."""
        z = self._design(x)
        p = sigmoid(z @ self.beta)
        hessian = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z
        return np.r_[len(x), z.T @ (y - p), hessian.ravel()]

    def step(self, sums: np.ndarray) -> float:
        """One Newton step; returns the largest change it asks for."""
        d = len(self.beta)
        penalty = np.r_[np.full(d - 1, self.l2), 1e-6]
        change = np.linalg.solve(sums[1 + d :].reshape(d, d) + np.diag(penalty + 1e-9), sums[1 : 1 + d] - penalty * self.beta)
        self.beta = self.beta + np.clip(change, -5, 5)
        return float(np.abs(change).max())

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        for _ in range(25):
            if self.step(self.sums(x, y)) < 1e-6:
                break
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.beta, -LIMIT, LIMIT)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(x))


@dataclass
class Model:
    """Two views, their calibration, and how they are combined."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic

    def __call__(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [c(logit(v(a))[:, None]) for v, c, a in zip(self.views, self.calibrations, x)]
        return own[0], own[1], self.combined(np.stack([logit(p) for p in own], 1))


@dataclass
class Round:
    """What a round hands out: per view its model, and the cutoffs of its labels 0 and 1 in log odds."""

    views: list[Logistic]
    cutoffs: list[tuple[float, float]]


def taught(x: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """Per view, the pseudo-label that each document got first from the other view; -1 for none."""
    labels = [np.full(len(x[0]), -1) for _ in x]
    for r in rounds:
        for view, other in ((0, 1), (1, 0)):
            odds, free = r.views[view].log_odds(x[view]), labels[other] < 0
            labels[other][free & (odds >= r.cutoffs[view][1])] = 1
            labels[other][free & (odds <= -r.cutoffs[view][0])] = 0
    return labels


def _summed(pool: DataFrame, sums: Callable[[list[np.ndarray]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, dict[int, float]]:
    """Arrays that tasks give for (a, b) under a number, summed in Spark: number to place to sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = [batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (0, 1)]
                for number, found in sums(x):
                    total[number] = total.get(number, 0) + found
        for number, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), number)), pa.array(at), pa.array(found[at].astype(float))], ["number", "at", "total"])

    rows = pool.select("a", "b").mapInArrow(run, "number long, at long, total double").groupBy("number", "at").agg(
        F.sum("total").alias("total")).collect()  # as many as the arrays have places
    out: dict[int, dict[int, float]] = {}
    for number, at, total in rows:
        out.setdefault(number, {})[at] = total
    return out


def _cutoffs(counts: dict[int, float], quota: list[float], sure: float) -> tuple[float, float]:
    """The least log odds, per label, at which the surest fresh documents reach the quota."""
    found, middle, least = [], BINS * LIMIT, int(np.ceil(BINS * logit(sure)))
    for label, sign in ((0, -1), (1, 1)):
        edge, left = np.inf, quota[label]
        inward = {}  # bins by their edge nearest to zero
        for at, n in counts.items():
            near = at - middle if sign > 0 else middle - at - 1
            if near >= least:
                inward[near] = n
        for near in sorted(inward, reverse=True):
            if left <= 0:
                break
            edge, left = near / BINS, left - inward[near]
        found.append(edge)
    return found[0], found[1]


def co_train(x: list[np.ndarray], y: np.ndarray, aside: np.ndarray, pool: DataFrame | None,
             rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """Fit both views on labelled rows and each other's confident labels for the pool (a, b)."""
    if any(len(np.unique(y[part])) < 2 for part in (aside, ~aside)):
        return None
    own = [[v[~aside & (y == label)] for label in (0, 1)] for v in x]
    share = y[~aside].mean()
    views = [Logistic(v[~aside]) for v in x]
    done: list[Round] = []

    def newton() -> float:
        """A step of both views on own and taught rows, classes weighted alike."""
        if done:
            def of_pool(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
                for view, labels in enumerate(taught(rows, done)):
                    for label in (0, 1):
                        if (labels == label).any():
                            yield 2 * view + label, views[view].sums(rows[view][labels == label], label)
            found = _summed(pool, of_pool)
        change = 0.0
        for view, model in enumerate(views):
            sums = [model.sums(own[view][label], label) for label in (0, 1)]
            for label in (0, 1) if done else ():
                at = found.get(2 * view + label, {})
                sums[label][list(at)] += list(at.values())
            n = sums[0][0] + sums[1][0]
            change = max(change, model.step(sum(s * n / (2 * s[0]) for s in sums)))
        return change

    for _ in range(25):
        if newton() < 1e-6:
            break
    for _ in range(rounds if pool is not None else 0):
        def fresh(rows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
            labels = taught(rows, done)
            for view, other in ((0, 1), (1, 0)):
                odds = views[view].log_odds(rows[view][labels[other] < 0])
                at = np.floor(odds * BINS).astype(np.int64) + BINS * LIMIT
                yield view, np.bincount(at, minlength=2 * BINS * LIMIT + 1)
            yield 2, np.array([len(labels[0])])
        counts = _summed(pool, fresh)
        if 2 not in counts:
            break
        quota = counts[2][0] / (2 * rounds)
        done.append(Round([copy(v) for v in views], [
            _cutoffs(counts.get(view, {}), [quota * (1 - share), quota * share], sure) for view in (0, 1)]))
        for model in views:
            model.beta = np.zeros_like(model.beta)
        for _ in range(STEPS):
            if newton() < 1e-2:
                break
    cal = [Logistic(o := logit(v(a[aside]))[:, None]).fit(o, y[aside]) for v, a in zip(views, x)]
    both = np.stack([logit(c(logit(v(a[aside]))[:, None])) for v, c, a in zip(views, cal, x)], 1)
    return Model(views, cal, Logistic(both).fit(both, y[aside]))


def _columns(docs: DataFrame, text_col: str) -> list:
    have = {c.lower() for c in docs.columns}
    return [text_of(text_col).alias("__text__"),
            *[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(f"__{c}__")
              for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]]


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    text, lang, source, size = (batch.column(i) for i in range(4))
    a, b = [], []
    for t, la, s, n in zip(text, lang.to_pylist(), source.to_pylist(), size.to_pylist()):
        t = t.as_py()
        a.append(content(t))
        b.append(metadata(t, la, s, n))
    return [np.array(a), np.array(b)]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS,
        rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on a bounded sample of labelled rows by hash of the id, a fifth of them kept aside, and on all
    unlabelled ones."""
    known = staged(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("string").alias("key")).agg(F.min(label_col).cast("int").alias("y")), "quality-labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))],
                ["key", "a", "b"])

    rows = docs.select(*_columns(docs, text_col), F.col(id_col).cast("string").alias("key"))
    features = staged(rows.mapInArrow(run, "key string, a array<double>, b array<double>"), "quality-features")
    # A hash below the cutoff first, so that no task sorts more than a few times max_rows.
    most = known.count()
    chosen = known.where(F.abs(F.xxhash64("key") % 1_000_003) < 1_000_003 * min(1.0, 2 * max_rows / max(1, most)))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    sample = features.join(F.broadcast(chosen), "key")  # max_rows rows of an id and a label
    sample = sample.groupBy("key").agg(F.min(F.struct("y", "a", "b")).alias("row")).select(
        F.crc32(F.col("key").cast("binary")).alias("id"), "row.*").toPandas().sort_values(["id", "y"], kind="stable")
    if not len(sample):
        return None
    pool = staged(features.join(known.select("key"), "key", "left_anti").select("a", "b"), "quality-pool")
    x = [np.stack(sample[c].to_numpy()) for c in ("a", "b")]
    return co_train(x, sample.y.to_numpy(float), sample.id.to_numpy() % 5 == 0, pool, rounds)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the two views' calibrated scores, the combined score, and whether the document is kept."""
    others = [c for c in docs.columns if c.lower() not in OUT]
    rows = docs.select(*_columns(docs, text_col), *[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*rows.schema[4:], *[T.StructField(c, T.DoubleType()) for c in OUT[:3]],
                           T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = model(_views(batch)) if model is not None and n else [np.full(n, 0.5)] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[4:], *[pa.array(s) for s in found], pa.array(found[2] >= threshold)], schema.names)

    return rows.mapInArrow(run, schema)
