"""Digests over sets of rows.

``set_digest`` is the default: an order-independent aggregate (count, XOR and sum of
60-bit hashes), so every partition contributes a few numbers and nothing is sorted.
``id_digest`` is its form for frozen id sets of any size. ``exact_*`` give the digest
over the sorted concatenation, for comparing with files that hold one; that string has
to exist in one place, so they are refused beyond a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.hashing import content_hash_of_array, sha60, short_sha

EXACT_LIMIT = 100_000


def set_digest_parts(member: Column) -> list[Column]:
    h = sha60(member)
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("s"),
    ]


def set_digest(df: DataFrame, *members: Column, name: str = "digest") -> DataFrame:
    """One row with a 16-digit digest of the multiset of rows."""
    member = F.concat_ws("\u0000", *[F.coalesce(m.cast("string"), F.lit("")) for m in members])
    return df.agg(*set_digest_parts(member)).select(
        short_sha(F.concat_ws("|", "n", "x", F.col("s").cast("string"))).alias(name))


def id_digest(ids: DataFrame, column: str = "forum_id", name: str = "hash") -> DataFrame:
    """Digest of a set of ids: order and repetition do not matter."""
    return set_digest(ids.select(F.col(column).cast("string").alias("id")).distinct(), F.col("id"), name=name)


def corpus_digest(forum: DataFrame, review: DataFrame, name: str = "corpus_hash") -> DataFrame:
    """Digest over all forum ids and all (forum id, review note id) pairs."""
    ids = forum.select(F.col("forum_id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    notes = review.select(F.col("forum_id").cast("string"), F.coalesce(F.col("note_id").cast("string"), F.lit("")))
    return set_digest(ids.unionAll(notes), F.col("a"), F.col("b"), name=name)


def _refuse_above(df: DataFrame, limit: int) -> None:
    if df.limit(limit + 1).count() > limit:
        raise ValueError(
            f"more than {limit} rows: the sorted concatenation needs one place for all of "
            "them; use set_digest/corpus_digest")


def exact_id_hash(ids: DataFrame, column: str = "forum_id", limit: int = EXACT_LIMIT) -> DataFrame:
    """`content_hash` over the sorted distinct ids, for small frozen id sets."""
    one = ids.select(F.col(column).cast("string").alias("id")).distinct()
    _refuse_above(one, limit)
    return one.agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        content_hash_of_array(F.col("ids")).alias("hash"))


def exact_corpus_hash(forum: DataFrame, review: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """SHA-256 over forum ids in order, each followed by its sorted review ids."""
    ids = forum.select(F.col("forum_id").cast("string").alias("f"), F.lit("").alias("r"), F.lit(0).alias("k"))
    notes = review.select(F.col("forum_id").cast("string"),
                          F.coalesce(F.col("note_id").cast("string"), F.lit("")), F.lit(1))
    both = ids.unionAll(notes)
    _refuse_above(both, limit)
    return both.agg(F.array_sort(F.collect_list(F.struct("f", "k", "r"))).alias("all")).select(
        short_sha(F.array_join(F.transform("all", lambda e: F.when(e.k == 0, e.f).otherwise(e.r)), ""))
        .alias("corpus_hash"))
