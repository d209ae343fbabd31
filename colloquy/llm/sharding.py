"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A keyed Feistel network permutes the numbers below a power of four; numbers that fall at or
above the row count are fed through again until they fall below it, which leaves a permutation of
the row numbers. Position p goes to shard p mod S and slot p div S, so counts differ by one at
most, and both directions can be computed without a table.

Row numbers depend on the rows alone, not on files or partitions: rows are counted per
(id, size, crc), put into a fixed number of hash buckets and numbered inside each; the buckets'
counts, one row per bucket, give the offsets.

Defined results: a null text has size 1 and the crc of nothing; null ids are an id like any other;
rows that agree in id, size and crc get neighbouring numbers and so different slots; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
BUCKETS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(values: np.ndarray, half_bits: int, seed: int, inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << half_bits) - 1)
    left, right = values >> np.uint64(half_bits), values & mask
    for r in range(ROUNDS)[:: -1 if inverse else 1]:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
        if inverse:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << np.uint64(half_bits)) | right


def permute(values: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The place of each row number below n, or with `inverse` the row number at each place."""
    out = np.asarray(values, np.uint64)
    half_bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out, walking = out.copy(), np.ones(len(out), bool)
    while walking.any():
        out[walking] = _network(out[walking], half_bits, seed, inverse)
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (id, size, crc): first row number, copies, and the number of all rows."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    groups = (
        docs.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"),
                    F.crc32(raw).alias("text_crc32"))
        .groupBy(id_col, "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(BUCKETS)))
    )
    inside = Window.partitionBy("bucket").orderBy(id_col, "size", "text_crc32")
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        groups.groupBy("bucket").agg(F.sum("copies").alias("n"))
        .select("bucket", (F.sum("n").over(upto) - F.col("n")).alias("offset"),
                F.sum("n").over(Window.partitionBy()).alias("total"))
    )  # at most BUCKETS rows
    start = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    return (
        groups.withColumn("start", start).join(F.broadcast(offsets), "bucket")
        .select(id_col, "size", "text_crc32", "copies", "total",
                (F.col("start") + F.col("offset")).alias("first_row"))
    )


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Each row's size, crc, row number, position in the shuffle, shard and slot."""

    @F.pandas_udf("long")
    def place(row: pd.Series, total: pd.Series) -> pd.Series:
        if not len(row):
            return pd.Series([], dtype="int64")
        return pd.Series(permute(row.to_numpy(), int(total.iloc[0]), seed))

    rows = numbered(docs, id_col, text_col).select(
        id_col, "size", "text_crc32", "total",
        F.explode(F.sequence("first_row", F.col("first_row") + F.col("copies") - 1)).alias("row_number"))
    return rows.withColumn("position", place("row_number", "total")).select(
        id_col, "size", "text_crc32", "row_number", "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"))
