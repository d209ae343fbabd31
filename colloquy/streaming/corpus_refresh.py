"""The corpus refresh as one step per micro-batch: fetched forums, refresh states, public texts, manifest.

A batch of fetched forums is written once, whole and redacted, in folders of its own. A `StateTable` of
pointers says for every forum which batch holds its current version, so a refreshed forum replaces its
old reviews without touching them, and a forum that was fetched earlier than the one it would replace is
ignored. The pointer also holds the forum's share of the corpus digest. Count, XOR and sum can be undone,
so the manifest follows from the one before and the touched forums: old shares go, new ones come. A full
recomputation gives the same.

Pointers are committed last. A batch that is repeated after any failure starts from the commits of
earlier batches and writes the same paths.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions.digests import set_digest_parts
from colloquy.functions.hashing import short_sha
from colloquy.operators.ingest import Corpus
from colloquy.sources.corpus import redact_texts
from colloquy.streaming.refresh import current_states, replay_batches
from colloquy.streaming.state_table import BUCKETS, FOLD, StateTable, names_in

ZERO = "decimal(38,0)"


def digest_shares(forum: DataFrame, review: DataFrame) -> DataFrame:
    """Per forum what it adds to the corpus digest (n, x, s), and its number of reviews."""
    name = F.col("forum_id").cast("string")
    ids = forum.select("forum_id", F.concat_ws("\u0000", F.coalesce(name, F.lit("")), F.lit("")).alias("m"), F.lit(0).alias("r"))
    notes = review.select("forum_id", F.concat_ws("\u0000", F.coalesce(name, F.lit("")), F.coalesce(
        F.col("note_id").cast("string"), F.lit(""))), F.lit(1))
    return ids.unionAll(notes).groupBy("forum_id").agg(*set_digest_parts(F.col("m")), F.sum("r").alias("n_reviews"))


class RefreshedCorpus:
    """A corpus under ``path`` that grows and is refreshed by batches."""

    TABLES = ("forum", "review", "response", "public_review", "public_response")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fold: int = FOLD):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = StateTable(spark, f"{self.path}/pointers", "forum_id", buckets, fold)
        self._states = replay_batches(f"{self.path}/states", buckets=buckets, fold=fold)

    def _store(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def apply(self, batch_id: int, fetched: Corpus, results: DataFrame) -> None:
        """Take in a batch: one row per fetched forum with its reviews and responses, and the results of
        all refresh attempts (see `operators.refresh`)."""
        with ThreadPoolExecutor(4) as pool:  # jobs that do not wait for each other fill the cluster together
            review, response, forum = (pool.submit(self._store, df, name, batch_id) for df, name in (
                (fetched.review, "review"), (fetched.response, "response"), (fetched.forum, "forum")))
            others = [pool.submit(self._states, results, batch_id)]
            forum, review = forum.result(), review.result()
            texts = [c for c in S.REVIEW_TEXTS if c in review.columns]
            others.append(pool.submit(self._store, redact_texts(review, texts), "public_review", batch_id))
            others.append(pool.submit(self._store, redact_texts(response.result(), ["text"]), "public_response", batch_id))
            moved = self._moves(forum, review, batch_id)
            for job in others:
                job.result()
        self.pointers.commit(batch_id, moved.select("forum_id", "n", "x", "s", "n_reviews", "fetched_at", "version"))

    def _moves(self, forum: DataFrame, review: DataFrame, batch_id: int) -> DataFrame:
        """Forums whose current version the batch holds, with their old shares; writes the manifest after them."""
        before = self.pointers.latest(batch_id)
        touched = [r.b for r in forum.select(self.pointers.bucket().alias("b")).distinct().collect()]
        known = self.pointers.read(before, touched)
        shares = digest_shares(forum, review).join(forum.select("forum_id", "fetched_at"), "forum_id").withColumn(
            "version", F.lit(batch_id))
        none = F.lit(None)
        old = shares.select("forum_id", *[none.cast(t).alias(f"old_{c}") for c, t in (
            ("n", "bigint"), ("x", "bigint"), ("s", ZERO), ("n_reviews", "bigint"), ("fetched_at", "double"))]).limit(0)
        if known is not None:
            old = known.select("forum_id", *[F.col(c).alias(f"old_{c}") for c in ("n", "x", "s", "n_reviews", "fetched_at")])
        moved = self._store(shares.join(old, "forum_id", "left").where(
            F.col("old_fetched_at").isNull() | (F.col("fetched_at") >= F.col("old_fetched_at"))), "moves", batch_id)
        self._store(self._manifest_after(moved, before.batch_id), "manifest", batch_id)
        return moved

    def _manifest_after(self, moved: DataFrame, last: int) -> DataFrame:
        """The parts of the manifest: those of the last one, changed by what the moved forums had and have."""
        was = lambda c: F.coalesce(f"old_{c}", F.lit(0))
        zero = lambda e: F.coalesce(e, F.lit(0))
        change = moved.agg(
            F.count_if(F.col("old_n").isNull()).alias("record_count"),
            zero(F.sum(F.col("n_reviews") - was("n_reviews"))).cast("bigint").alias("review_count"),
            zero(F.sum(F.col("n") - was("n"))).cast("bigint").alias("n"),
            zero(F.bit_xor(F.col("x").bitwiseXOR(was("x")))).cast("bigint").alias("x"),
            zero(F.sum(F.col("s") - was("s"))).cast(ZERO).alias("s"))
        if last < 0:
            return change
        both = self.spark.read.parquet(f"{self.path}/manifest/batch_id={last}").unionByName(change)
        return both.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("record_count", "review_count", "n")],
                        F.bit_xor("x").alias("x"), F.sum("s").cast(ZERO).alias("s"))

    # --- reading ------------------------------------------------------------------------

    def _last(self) -> int:
        last = self.pointers.latest().batch_id
        if last < 0:
            raise ValueError(f"{self.path}: no batch was committed")
        return last

    def manifest(self) -> DataFrame:
        """Counts and digest, as `sources.corpus.manifest` computes them from all rows."""
        return self.spark.read.parquet(f"{self.path}/manifest/batch_id={self._last()}").select(
            "record_count", "review_count",
            short_sha(F.concat_ws("|", "n", "x", F.col("s").cast("string"))).alias("corpus_hash"))

    def table(self, name: str) -> DataFrame:
        """The current rows of one of TABLES."""
        if name not in self.TABLES:
            raise ValueError(f"unknown table: {name!r}")
        last = self._last()  # folders of a batch that was not committed are not read
        written = [int(n.removeprefix("batch_id=")) for n in names_in(self.spark, f"{self.path}/{name}")]
        paths = [f"{self.path}/{name}/batch_id={n}" for n in sorted(written) if n <= last]
        now = self.pointers.states()
        if now is None:
            return self.spark.read.parquet(*paths).limit(0)
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        current = now.select("forum_id", F.col("version").alias("batch_id"))
        return rows.join(current, ["forum_id", "batch_id"], "left_semi").drop("batch_id")

    def corpus(self, public: bool = False) -> Corpus:
        kind = "public_" if public else ""
        return Corpus(self.table("forum"), self.table(f"{kind}review"), self.table(f"{kind}response"))

    def states(self) -> DataFrame:
        return current_states(self.spark, f"{self.path}/states")
