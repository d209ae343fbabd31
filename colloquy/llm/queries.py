"""One query per operator over its whole table, and oracle SQL where SQL can express it.

The operators return texts, ids and spans; the queries derive the columns of their contracts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    bpe,
    chat,
    embedding_dedup,
    exact_dedup,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    topk,
    toxicity,
    trie,
)
from colloquy.llm.common import staged

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_file() -> str:
    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("long").alias(f"n_{kind}")
              for i, kind in enumerate(pii.KINDS[:4])]
    every = found.withColumn("all_spans", F.expr(
        "array_sort(concat(transform(spans, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)), "
        "transform(terms, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))))"))
    return every.select(
        F.col("id").alias("doc_id"), *counts,
        F.sha2(pii.listed("spans").cast("binary"), 256).alias("base_sha256"),
        pii.listed("all_spans").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels, usable=fold != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.coalesce(fold, F.lit(-1)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(_table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "turn", "part", "role", "rendered")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, tokenizer_file()), tokenizer_file())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "content_score", "metadata_score", "score", "kept")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with turns of the first one of its twenty.

    The first h turns of conversation c - c % 20, then its own from turn h on, for h = crc32(c) % 4.
    """
    turns = staged(turns, "numbered")
    convs = staged(turns.groupBy("conv").agg(F.count("*").alias("size")).select(
        "conv", "size", (F.col("conv") - F.pmod("conv", F.lit(20))).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h")), "conversations")
    given = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = staged(convs.join(convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left").select(
        "conv", "base", "h", given.alias("given")), "plan")
    own = turns.join(convs, "conv").where(F.col("pos") >= F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "words")
    start = turns.where("pos < 3").withColumnRenamed("conv", "base")
    lent = convs.where("given > 0").select("conv", "base", "given").join(start, "base").where("pos < given")
    return own.unionByName(lent.select("conv", "pos", "digest", "words")), convs.select("conv")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(_table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*rebuilt(turns)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without one code point, where 97 divides the checksum of id and run."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 97 == 0, cut).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), change=misspelt)
    return spelling.group_variants(words).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {q.__name__: q for q in (
    op1_sharding, op2_exact_dedup, op3_pii, op4_packing, op5_top_k, op6_toxicity, op7_simhash, op8_chat,
    op9_bpe, op10_quality, op11_embedding_near_dedup, op12_prefix_trie, op13_spelling_variants)}

ORACLES = {
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op11_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x for x in embedding if x <> 0]) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a
        ), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
        SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
