"""Near-duplicate embeddings through binary codes of randomly rotated vectors.

Equal vectors are one node with a weight, so copies are never paired. A node's code holds the signs of
its unit vector under random rotations, and with each rotation a correction factor, the inner product
of the vector with its own sign vector. Divided by that factor, the sign vector is an unbiased estimate
of the vector; its inner product with another node's vector, whose components were rounded at random to
four bits, is an unbiased estimate of their cosine. Its error is known from the correction factors, so
a pair goes on to exact recomputation only if the estimate lies within `deviations` standard errors of
the threshold or above. Links come from exact cosines in double precision alone.

Pairs meet in tables over the same codes: table t holds a node under `bits` of its code bits, and the
number of tables is set so that a pair at the threshold shares a key in one of them with probability
1 - `miss`. Keys grow with the logarithm of the number of nodes, so keys keep about `cell_rows` nodes.
A key with more than `tile_rows` nodes is cut into tiles; every pair of its tiles is a cell of its own.
A pair counts in the first table whose key it shares, which the codes tell, so no set of pairs is ever
written: a first pass carries codes only and returns, per cell, the groups of nodes that estimates
connect; a second one carries vectors of these nodes, recomputes within each group and returns degrees
and a spanning forest of the links. Components follow from the forests.

Defined results: vectors that are null, all zero, or hold null or non-finite components link with
nothing, not even their copies; components missing from shorter vectors count as zero; null ids count
as links but not for component ids, and a component of null ids only has none; repeated rows are
copies; an empty table gives an empty result; other columns are ignored. Equality of vectors is that
of a 128-bit digest of their components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import row_id, staged
from colloquy.llm.simhash import components, unite

CODE_BITS = 256  # rotations are added until codes have as many bits
CELL_ROWS = 512
TILE_ROWS = 4096
BLOCK = 1 << 20  # pairs held at a time


@lru_cache(maxsize=4)
def rotations(width: int, seed: int) -> np.ndarray:
    """Random rotations of `width` dimensions, enough for CODE_BITS signs."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(max(1, math.ceil(CODE_BITS / width))):
        q, r = np.linalg.qr(rng.standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def noise(nodes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Random numbers from 0 to 1 that are a function of the node, so that a retried task repeats them."""
    x = nodes.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64) + np.uint64(seed << 40)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) / 2.0**53


class Coder:
    """Codes of unit vectors, estimates between codes and the tables over their bits."""

    def __init__(self, size: int, seed: int, threshold: float = 0.95, deviations: float = 4.0):
        self.size = size
        self.width = max(64, -(-size // 8) * 8)  # short vectors are padded: signs need some dimensions
        self.seed, self.threshold, self.deviations = seed, threshold, deviations
        self.turns = max(1, math.ceil(CODE_BITS / self.width))
        self.bits = self.turns * self.width
        self.bytes = self.bits // 8 + 2 * self.turns + 4 + self.width // 2

    def encode(self, vectors: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """One row of bytes per vector: signs, correction factors, then the vector in four bits."""
        z = np.zeros((len(vectors), self.width))
        z[:, : vectors.shape[1]] = vectors
        turned = np.einsum("nd,rde->nre", z, rotations(self.width, self.seed))
        factor = np.abs(turned).sum(2) / math.sqrt(self.width)
        first = turned[:, 0]
        low = first.min(1)
        step = np.maximum((first.max(1) - low) / 15, 1e-12)
        low, step = low.astype("<f2"), step.astype("<f2")
        level = (first - low[:, None].astype(float)) / np.maximum(step[:, None].astype(float), 1e-7)
        level = np.clip(np.floor(level + noise(nodes, self.width, self.seed)), 0, 15).astype(np.uint8)
        return np.concatenate([
            np.packbits(turned.reshape(len(z), -1) > 0, axis=1),
            factor.astype("<f2").view(np.uint8).reshape(len(z), -1),
            np.stack([low, step], 1).view(np.uint8).reshape(len(z), -1),
            level[:, ::2] << 4 | level[:, 1::2]], axis=1)

    def signs(self, code: np.ndarray) -> np.ndarray:
        return np.unpackbits(code[:, : self.bits // 8], axis=1)

    def decode(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(four-bit vectors, estimates of the vectors from signs, least estimate worth recomputing)."""
        at, to = self.bits // 8, self.bits // 8 + 2 * self.turns
        factor = np.ascontiguousarray(code[:, at:to]).view("<f2").astype(np.float64)
        low, step = np.ascontiguousarray(code[:, to : to + 4]).view("<f2").T.astype(np.float64)
        packed = code[:, to + 4 :]
        level = np.stack([packed >> 4, packed & 15], 2).reshape(len(code), -1)
        query = low[:, None] + step[:, None] * level
        sign = 2.0 * self.signs(code).reshape(len(code), self.turns, self.width) - 1
        sign /= factor[:, :, None] * (math.sqrt(self.width) * self.turns)
        turn = rotations(self.width, self.seed)
        guess = np.einsum("nre,rde->nd", sign, turn) @ turn[0]
        # orthogonal to the vector, signs err by sqrt(1/f^2 - 1) spread over the other dimensions
        spread = np.maximum(1 / factor**2 - 1, 0).sum(1) / (self.turns**2 * (self.width - 1))
        spread = spread * (1 - self.threshold**2)
        rounding = (step / 2) ** 2 * (guess**2).sum(1)
        return query, guess, self.threshold - self.deviations * np.sqrt(spread + rounding.max(initial=0.0))

    def plan(self, nodes: int, cell_rows: int, miss: float) -> np.ndarray:
        """The code bits of each table, one row per table."""
        agree = 1 - math.acos(self.threshold) / math.pi
        take = min(self.bits, 48, max(0, math.ceil(math.log2(max(nodes, 1) / cell_rows))))
        chance = agree**take
        tables = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))
        rng = np.random.default_rng(self.seed + 1)
        return np.stack([rng.permutation(self.bits)[:take] for _ in range(tables)])

    def keys(self, code: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The key of each row in each table; its high bits number the table."""
        sign = self.signs(code).astype(np.int64)
        return np.stack([(t << 48) + sign[:, bits] @ (1 << np.arange(len(bits), dtype=np.int64))
                         for t, bits in enumerate(tables)], 1)


def padded(column: pa.Array, size: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(usable, the usable rows as a matrix)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    out = np.zeros((len(column), size), kind)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.to_numpy(zero_copy_only=False)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(1) & (out != 0).any(1)
    return usable, out[usable] + 0.0  # no negative zeros


def unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    out = raw.astype(np.float64)
    out /= np.abs(out).max(1, initial=0.0)[:, None]  # squares of very large components stay finite
    return out / np.sqrt((out**2).sum(1))[:, None]


def cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of equal values in the first `keys` columns, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if held:
            last = held[-1]
            if any(last.column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
                yield pa.concat_batches(held)
                held = []
        bounds = [0, *cut.tolist(), len(batch)]
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            yield pa.concat_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(bounds[-2]))
    if held:
        yield pa.concat_batches(held)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _sides(upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare: all with all within one tile, or the lower tile's with the upper one's."""
    if upper.any():
        return np.flatnonzero(~upper), np.flatnonzero(upper), False
    return np.arange(len(upper)), np.arange(len(upper)), True


def _earlier(keys: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs share a key in a table before this one."""
    out = np.zeros(len(i), bool)
    for t in range(table):
        out |= keys[i, t] == keys[j, t]
    return out


def _pairs(left: np.ndarray, right: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, slice]]:
    """Rows of the left side in blocks, with the rows of the right side to compare them with."""
    block = max(1, BLOCK // max(1, len(right)))
    for at in range(0, len(left), block):
        yield np.arange(at, min(at + block, len(left))), slice(at if within else 0, None)


def grouped(code: np.ndarray, keys: np.ndarray, upper: np.ndarray, table: int, coder: Coder) -> np.ndarray:
    """A label per row of a cell: rows that estimates connect, in a pair first met here, share one."""
    left, right, within = _sides(upper)
    query, guess, least = coder.decode(code)
    label = np.arange(len(code))
    for rows, rest in _pairs(left, right, within):
        a, b = left[rows], right[rest]
        near = (query[a] @ guess[b].T >= least[b]) | (guess[a] @ query[b].T >= least[a, None])
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        new = (i < j) if within else np.ones(len(i), bool)
        i, j = i[new], j[new]
        first = ~_earlier(keys, table, i, j)
        unite(label, i[first], j[first])
    return label


def linked(vectors: np.ndarray, keys: np.ndarray, weight: np.ndarray, upper: np.ndarray, table: int,
           threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each row's links first met here, label per row: linked rows share one)."""
    left, right, within = _sides(upper)
    degree, label = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for rows, rest in _pairs(left, right, within):
        a, b = left[rows], right[rest]
        i, j = np.nonzero(vectors[a] @ vectors[b].T >= threshold)
        i, j = a[i], b[j]
        new = (i < j) if within else np.ones(len(i), bool)
        i, j = i[new], j[new]
        first = ~_earlier(keys, table, i, j)
        i, j = i[first], j[first]
        np.add.at(degree, i, weight[j])
        np.add.at(degree, j, weight[i])
        unite(label, i, j)
    return degree, label


def digests(vectors: DataFrame, id_col: str, vector_col: str, size: int, kind: str, whole: bool) -> DataFrame:
    """(id, digest, raw) per row: both null if the vector is unusable, raw null unless `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, matrix = padded(batch.column(1), size, kind)
            raw = np.full(len(batch), None, object)
            raw[usable] = [v.tobytes() for v in matrix]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(digest, pa.binary()),
                pa.array(raw, pa.binary()) if whole else pa.nulls(len(batch), pa.binary())], ["id", "digest", "raw"])

    vector = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector).mapInArrow(
        run, "id long, digest binary, raw binary")


def near_links(nodes: DataFrame, size: int, kind: str, threshold: float, seed: int = 5, cell_rows: int = CELL_ROWS,
               tile_rows: int = TILE_ROWS, miss: float = 0.02) -> DataFrame:
    """(a, b, weight) from rows (node, weight, raw): per node a the weight of its links, b null, in parts;
    and edges (a, b), weight 0, which connect exactly what links connect."""
    coder = Coder(size, seed, threshold)
    tables = coder.plan(nodes.count(), cell_rows, miss)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit(_bytes(batch.column(1), int(kind[2]) * size).view(kind))
            code = coder.encode(vectors, batch.column(0).to_numpy())
            keys = coder.keys(code, tables)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(list(keys), pa.list_(pa.int64()))], ["node", "code", "keys"])

    coded = staged(nodes.select("node", "raw").mapInArrow(encode, "node long, code binary, keys array<long>"), "codes")
    hot = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(
        F.col("n") > tile_rows).select("key", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    hot = staged(hot, "large-keys")
    if hot.count() <= 100_000:  # a few MB; beyond, Spark joins by shuffle
        hot = F.broadcast(hot)
    placed = (
        coded.select("node", "code", F.explode("keys").alias("key")).join(hot, "key", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                (F.col("tile") > F.col("other")).alias("upper"), "node", "code")
    )

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, 3):
            code, upper = _bytes(cell.column(5), coder.bytes), cell.column(3).to_numpy(zero_copy_only=False)
            if len(cell) < 2 or cell.column(1)[0].as_py() != cell.column(2)[0].as_py() and (upper == upper[0]).all():
                continue
            label = grouped(code, coder.keys(code, tables), upper, cell.column(0)[0].as_py() >> 48, coder)
            held = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            if len(held):
                part = cell.take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], pa.array(label[held].astype(np.int64)), part.column(5)],
                    ["key", "low", "high", "upper", "node", "label", "code"])

    cell = ["key", "low", "high"]
    found = staged(
        placed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
            estimate, "key long, low int, high int, upper boolean, node long, label long, code binary"), "candidates")

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cells(batches, 4):
            vectors = unit(_bytes(group.column(8), int(kind[2]) * size).view(kind))
            keys = coder.keys(_bytes(group.column(6), coder.bytes), tables)
            node, weight = group.column(5).to_numpy(), group.column(7).to_numpy()
            upper = group.column(4).to_numpy(zero_copy_only=False)
            degree, label = linked(vectors, keys, weight, upper, group.column(0)[0].as_py() >> 48, threshold)
            some = np.flatnonzero(degree)
            tied = np.flatnonzero(label != np.arange(len(label)))
            a = np.r_[node[some], node[tied]]
            b = pa.array(np.r_[np.zeros(len(some), np.int64), node[label[tied]]],
                         mask=np.arange(len(a)) < len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), b, pa.array(np.r_[degree[some], np.zeros(len(tied), np.int64)])], ["a", "b", "weight"])

    group = [*cell, "label"]
    exact = found.join(nodes.select("node", "weight", "raw"), "node").select(
        *group, "upper", "node", "code", "weight", "raw")
    return staged(exact.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        recompute, "a long, b long, weight long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                    **options: float) -> DataFrame:
    """(id, n_links, component_id, kept) per row; `options` go to near_links."""
    size = max(1, vectors.agg(F.max(F.size(vector_col))).first()[0] or 0)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    nodes = digests(vectors, id_col, vector_col, size, kind, True).where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("weight"), F.min("id").alias("least_id"), F.first("raw").alias("raw"))
    nodes = staged(nodes.withColumn("node", row_id()), "nodes")
    rows = digests(vectors, id_col, vector_col, size, kind, False)
    links = near_links(nodes.select("node", "weight", "raw"), size, kind, threshold, **options)
    tied = staged(components(links.where("b is not null").select("a", "b")), "components")
    known = nodes.select("node", "digest", "weight", "least_id").join(tied, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    known = known.join(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    degree = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
    known = staged(known.join(degree, "node", "left").select(
        "digest", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "results")
    usable = rows.where("digest is not null").join(known, "digest").select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
