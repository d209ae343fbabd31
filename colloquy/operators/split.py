"""Labels, leakage-safe splits by forum, baselines and the evaluation dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.digests import corpus_digest, set_digest
from colloquy.functions.hashing import seeded_key
from colloquy.functions.rows import with_row
from colloquy.functions.text import is_blank
from colloquy.operators import order_stats as O


STRATUM = ["venue_family", "venue_year"]


# --- model-visible inputs and private labels --------------------------------------------


def model_inputs(forum: DataFrame) -> DataFrame:
    """The closed, model-visible projection: exactly seven columns."""
    return forum.select(
        "forum_id", L.family_label().alias("venue_family"), L.year_label().alias("venue_year"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.lit(S.INPUT_TIER).alias("input_tier"),
        F.lit(S.EVALUATION_SCHEMA_VERSION).alias("schema_version"),
    )


def rating_targets(review: DataFrame) -> DataFrame:
    """Sum and number of initial ratings per forum."""
    v = F.col("initial_value")
    return review.groupBy("forum_id").agg(F.sum(v).alias("_sum"), F.count(v).alias("_n"))


def private_labels(forum: DataFrame, review: DataFrame, digits: int | None = 4) -> DataFrame:
    """Both task labels of every forum."""
    n = F.coalesce("_n", F.lit(0))
    return forum.join(rating_targets(review), "forum_id", "left").select(
        "forum_id", L.family_label().alias("venue_family"), L.year_label().alias("venue_year"),
        L.rounded(L.ratio(F.col("_sum"), n), digits).alias("initial_rating_target"),
        F.lit(S.RATING_AGGREGATION).alias("initial_rating_aggregation"),
        n.alias("initial_rating_n"),
        (n > 0).alias("initial_rating_eligible"),
        F.when(L.is_resolved(), F.col("decision")).alias("final_decision_target"),
        F.coalesce("decision_raw", F.lit("")).alias("final_decision_raw"),
        L.is_resolved().alias("final_decision_eligible"),
        L.exclusion_reason().alias("final_decision_excluded_reason"),
    )


# --- split ------------------------------------------------------------------------------


def screen(forum: DataFrame, review: DataFrame, calibration: DataFrame) -> DataFrame:
    """Forums with the first reason that keeps them out of evaluation, if any."""
    cal = calibration.select("forum_id").distinct().withColumn("_cal", F.lit(True))
    return (
        forum.select("forum_id", L.family_label().alias("venue_family"),
                     L.year_label().alias("venue_year"), "decision",
                     (is_blank("title") & is_blank("abstract")).alias("_no_paper"))
        .join(rating_targets(review), "forum_id", "left")
        .join(cal, "forum_id", "left")
        .select(
            "forum_id", "venue_family", "venue_year",
            F.when(F.col("_cal").isNotNull(), S.EXCLUDED_CALIBRATION)
            .when((F.coalesce("_n", F.lit(0)) == 0) & ~L.is_resolved(), S.EXCLUDED_NO_LABELS)
            .when(F.col("_no_paper"), S.EXCLUDED_NO_PAPER).alias("reason"),
        )
    )


def stratum_quotas(sizes: DataFrame, max_forums: int) -> DataFrame:
    """Largest-remainder quotas in integer arithmetic. Input is one row per stratum
    with its ``size``, so the windows see strata and never forums.

    A share is smaller than the stratum (max_forums < total), hence base + 1 always
    fits and one round of extra seats is enough."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("size").over(every)
    scaled = F.col("size") * F.lit(max_forums)
    seats = (
        sizes.withColumn("_t", total)
        .withColumn("_base", F.expr(f"(size * {max_forums}L) div _t"))
        .withColumn("_rem", F.pmod(scaled, F.col("_t")))
    )
    by_remainder = W.orderBy(F.col("_rem").desc(), "venue_family", "venue_year")
    extra = F.lit(max_forums) - F.sum("_base").over(every)
    return seats.withColumn("_extra", extra).withColumn(
        "_rank", F.row_number().over(by_remainder)).select(
        "venue_family", "venue_year", "size",
        F.when(F.col("_t") <= max_forums, F.col("size"))
        .otherwise(F.col("_base") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0))
        .cast("bigint").alias("quota"))


def sampling_key(seed: int) -> Column:
    return seeded_key(seed, *STRATUM, "forum_id")


def subsample_cutoffs(eligible: DataFrame, max_forums: int, seed: int) -> DataFrame:
    """Per (family, year) the largest sampling key that still belongs to a seeded sample
    of ``max_forums`` forums, proportional over the strata."""
    return O.key_cutoffs(
        eligible.withColumn("_key", sampling_key(seed)), STRATUM, "_key",
        lambda sizes: stratum_quotas(sizes, max_forums))


def select_evaluation_forums(forum: DataFrame, review: DataFrame, calibration: DataFrame, *,
                             max_forums: int | None = None, seed: int = 0) -> DataFrame:
    """Every forum with ``reason`` NULL when it is in the evaluation set."""
    screened = screen(forum, review, calibration)
    if max_forums is None:
        return screened
    if max_forums <= 0:
        raise ValueError(f"max_forums must be positive, got {max_forums}")
    cutoffs = subsample_cutoffs(
        screened.where(F.col("reason").isNull()).drop("reason"), max_forums, seed)
    kept = F.coalesce(sampling_key(seed) <= F.col("cutoff"), F.lit(False))
    return screened.join(cutoffs, STRATUM, "left").select(
        "forum_id", *STRATUM,
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~kept, "subsampled_out").alias("reason"))


def stratify(forums: DataFrame) -> DataFrame:
    return forums.groupBy("venue_family", "venue_year").agg(F.count(F.lit(1)).alias("n"))


def exclusion_counts(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def overlap(left: DataFrame, right: DataFrame, key: str = "forum_id") -> DataFrame:
    """Keys in both sets; a split is sound when this is empty."""
    return left.select(key).join(right.select(key), key, "left_semi").distinct()


# --- leakage ----------------------------------------------------------------------------


def text_leaks(inputs: DataFrame, review: DataFrame, response: DataFrame, forum: DataFrame,
               min_chars: int = S.MIN_LEAK_CHARS) -> DataFrame:
    """Review, response and decision texts copied verbatim into the same forum's
    visible title and abstract. Equality on the forum id comes first; containment is
    tested on the joined rows only. Short texts are dropped before the shuffle."""
    fields = F.array(*[F.struct(F.lit(f"review.{c}").alias("field"), F.col(c).alias("needle"))
                       for c in S.REVIEW_TEXTS])
    long = F.length("needle") >= min_chars
    needles = (
        review.select("forum_id", "note_id", F.explode(fields).alias("_f"))
        .select("forum_id", F.col("note_id").cast("string"), "_f.field", "_f.needle")
        .unionByName(response.select(
            "forum_id", F.col("note_id").cast("string"), F.lit("response.text").alias("field"),
            F.col("text").alias("needle")))
        .unionByName(forum.select(
            "forum_id", F.lit("").alias("note_id"), F.lit("decision.raw_text").alias("field"),
            F.col("decision_raw").alias("needle")))
        .where(long)
    )
    visible = inputs.select("forum_id", F.lower(F.concat_ws("\n", "title", "abstract")).alias("_seen"))
    return (
        needles.join(visible, "forum_id")
        .where(F.contains(F.col("_seen"), F.lower("needle")))
        .select(*L.violation(
            "forum_id", "text_leak",
            F.concat_ws(":", "field", F.coalesce("note_id", F.lit("")))))
    )


# --- baseline ---------------------------------------------------------------------------


def calibration_aggregate(forum: DataFrame, review: DataFrame, calibration: DataFrame,
                          digits: int | None = 4) -> DataFrame:
    """One row: mean initial rating and majority decision of the calibration forums;
    no row when none of them is in the corpus. A tie goes to accept."""
    cal = calibration.select("forum_id").distinct()
    forums = forum.join(cal, "forum_id", "left_semi").agg(
        F.count(F.lit(1)).alias("calibration_forum_count"),
        F.count_if(F.col("decision") == "accept").alias("_acc"),
        F.count_if(F.col("decision") == "reject").alias("_rej"))
    ratings = review.join(cal, "forum_id", "left_semi").agg(
        F.sum("initial_value").alias("_sum"), F.count("initial_value").alias("_n"))
    return (
        with_row(forums, ratings)
        .where(F.col("calibration_forum_count") > 0)
        .select(
            "calibration_forum_count",
            L.rounded(L.ratio(F.col("_sum"), F.col("_n")), digits).alias("mean_initial_rating"),
            F.when((F.col("_acc") > 0) & (F.col("_acc") >= F.col("_rej")), "accept")
            .when(F.col("_rej") > 0, "reject").alias("majority_decision"))
    )


def baseline_predictions(eval_forums: DataFrame, aggregate: DataFrame) -> DataFrame:
    """The constant baseline for every evaluation forum."""
    return with_row(eval_forums.select("forum_id"), aggregate).where(
        F.col("calibration_forum_count").isNotNull()).select(
        "forum_id", F.lit(S.SYSTEM_BASELINE).alias("system"),
        F.col("mean_initial_rating").alias("rating_prediction"),
        F.col("majority_decision").alias("decision_prediction"),
        F.lit(None).cast("double").alias("accept_probability"))


# --- dataset ----------------------------------------------------------------------------


@dataclass
class EvaluationDataset:
    inputs: DataFrame
    labels: DataFrame
    split: DataFrame
    manifest: DataFrame


def inputs_digest(inputs: DataFrame, name: str = "model_inputs_hash") -> DataFrame:
    return set_digest(inputs, *[F.col(c) for c in S.MODEL_INPUT_FIELDS], name=name)


def labels_digest(labels: DataFrame, name: str = "private_labels_hash") -> DataFrame:
    return set_digest(labels, *[F.col(c) for c in sorted(labels.columns)], name=name)


def prepare_dataset(forum: DataFrame, review: DataFrame, response: DataFrame,
                    calibration: DataFrame, path: str, *, seed: int,
                    max_forums: int | None = None, digits: int | None = 4) -> EvaluationDataset:
    """Write split, inputs, labels and manifest under ``path`` and return them as read.

    Each step builds on the table written by the one before, so the selection runs once
    and a lost executor never sends a later step back to it. The calibration set is
    digested apart from the selection. Checks run on what was written; the manifest,
    which marks a dataset as complete, comes last, and an empty or overlapping split or
    a text leak raises before it. The texts the leak check reads must be there."""
    spark = forum.sparkSession
    for name, table, needed in (
        ("review", review, S.REVIEW_TEXTS), ("response", response, ["text"]), ("forum", forum, ["decision_raw"]),
    ):
        if missing := sorted(set(needed) - set(table.columns)):
            raise ValueError(f"the leak check needs the {name} columns {missing}")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    split = store(select_evaluation_forums(
        forum, review, calibration, max_forums=max_forums, seed=seed), "split")
    chosen = split.where(F.col("reason").isNull()).select("forum_id")
    eval_forum = forum.join(chosen, "forum_id", "left_semi")
    inputs = store(model_inputs(eval_forum), "model_inputs")
    if inputs.isEmpty():
        raise ValueError("no evaluation forums remain; see the reasons in the split table")
    if not overlap(inputs, calibration).isEmpty():
        raise ValueError("calibration and evaluation forums overlap")
    if not text_leaks(inputs, review, response, eval_forum).isEmpty():
        raise ValueError("review text leaked into model-visible inputs")
    eval_review = review.join(chosen, "forum_id", "left_semi")
    labels = store(private_labels(eval_forum, eval_review, digits), "private_labels")

    counts = labels.agg(
        F.count(F.lit(1)).alias("eval_forum_count"),
        F.count_if("initial_rating_eligible").alias("initial_rating_eligible_count"),
        F.count_if("final_decision_eligible").alias("final_decision_eligible_count"))
    manifest = counts.withColumns({
        "seed": F.lit(seed), "schema_version": F.lit(S.EVALUATION_SCHEMA_VERSION)})
    for one_row in (
        set_digest(calibration.select("forum_id").distinct(), F.col("forum_id"),
                   name="calibration_hash"),
        corpus_digest(forum, review), inputs_digest(inputs), labels_digest(labels),
    ):
        manifest = with_row(manifest, one_row)
    return EvaluationDataset(inputs, labels, split, store(manifest, "manifest"))


def load_dataset(spark: SparkSession, path: str) -> EvaluationDataset:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return EvaluationDataset(
        read("model_inputs"), read("private_labels"), read("split"), read("manifest"))
