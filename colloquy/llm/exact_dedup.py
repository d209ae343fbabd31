"""Exact deduplication by skew-safe combining, on built-in functions only.

Texts are equal when they agree after lower-casing A-Z. Three stages, each grouping by digest and
by the whole normalised text, so that digests never decide alone:

1. the partial aggregate combines the copies inside each input partition;
2. these winners meet in salted groups, the salt being taken from the input partition, so that a
   text with copies everywhere is spread over `salts` groups of a few rows per partition;
3. the salts' winners, at most `salts` rows per text, are combined for good.

Documents then look their digest up among the winners, which carry no text. Should two different
texts share a digest, the winners carry the texts of that digest and the look-up compares them.

Defined results: a null text is empty; null ids are smaller than any id, and a group with null ids
only has a null keep_id; among rows of one group with the same largest id the first in the table
stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import ROW, ascii_lower, numbered, row_id, staged, text_of

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size; norm only if its digest is not unique."""
    local = (
        docs.select(F.col(id_col).alias("id"), ascii_lower(text_of(text_col)).alias("norm"),
                    (F.spark_partition_id() % salts).alias("salt"))
        .withColumn("digest", digest(F.col("norm")))
        .groupBy("digest", "norm", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    )
    merged = (
        local.repartition("digest").groupBy("digest", "norm")
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    texts = F.count("*").over(Window.partitionBy("digest"))
    return merged.select("digest", "keep_id", "group_size",
                         F.when(texts > 1, F.col("norm")).alias("norm"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                digest: Callable[[Column], Column] = sha256, row_col: str | None = None) -> DataFrame:
    """Per row of docs: row_id, id, keep_id, group_size, kept, digest.

    A row's identity is its number in `row_col`, or else its place in the one scan that names rows.
    """
    best = staged(winners(docs, id_col, text_col, salts, digest), "winners")
    rows = (
        docs.select((F.col(row_col) if row_col else row_id()).alias("row_id"), F.col(id_col).alias("id"),
                    ascii_lower(text_of(text_col)).alias("norm"))
        .withColumn("digest", digest(F.col("norm")))
    )
    shared = best.where("norm is not null")
    own = rows.drop("norm").join(best.where("norm is null").drop("norm"), "digest")
    if not shared.isEmpty():
        own = own.unionByName(rows.join(shared, ["digest", "norm"]).drop("norm"))
    found = staged(own.select("row_id", "id", "keep_id", "group_size", "digest"), "rows")
    best_row = F.col("id").eqNullSafe(F.col("keep_id"))
    ties = (
        found.where(best_row).groupBy("digest", "keep_id")
        .agg(F.min("row_id").alias("first_row"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("digest").alias("tied_digest"), F.col("keep_id").alias("tied_id"), "first_row")
    )
    tied = (F.col("digest") == F.col("tied_digest")) & F.col("keep_id").eqNullSafe(F.col("tied_id"))
    first = F.col("first_row").isNull() | (F.col("first_row") == F.col("row_id"))
    return found.join(ties, tied, "left").select(
        "row_id", "id", "keep_id", "group_size", (best_row & first).alias("kept"), "digest")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns."""
    rows = numbered(docs)
    stay = deduplicate(rows, id_col, text_col, row_col=ROW).where("kept").select(F.col("row_id").alias(ROW))
    return rows.join(stay, ROW, "left_semi").drop(ROW)
