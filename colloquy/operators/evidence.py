"""Stratified, seeded evidence selection and the checks on an evidence bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.digests import id_digest
from colloquy.functions.hashing import evidence_id, seeded_key
from colloquy.functions.rows import with_row
from colloquy.functions.text import excerpt_source, is_blank
from colloquy.operators import order_stats as O
from colloquy.operators.statistics import response_counts

REQUIRED_FIELDS = (
    "evidence_id", "venue_family", "forum_id", "note_id", "source_url",
    "rating_designation", "decision", "content_hash", "corpus_hash", "venue_year",
)


def rating_ranges(review: DataFrame) -> DataFrame:
    """max - min of initial ratings for forums with at least two of them."""
    v = F.col("initial_value")
    return (
        review.groupBy("forum_id")
        .agg(F.count(v).alias("_n"), (F.max(v) - F.min(v)).alias("rating_range"))
        .where(F.col("_n") >= 2).drop("_n")
    )


def median_range(review: DataFrame) -> DataFrame:
    """One row: the exact median of all forums' rating ranges."""
    return O.medians(O.histogram(rating_ranges(review), [], "rating_range"), [], "rating_range")


def without(df: DataFrame, ids: DataFrame | None, key: str = "forum_id") -> DataFrame:
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_anti")


def rated_candidates(review: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """Reviews that have text to quote, with their designated rating. The texts
    themselves are not carried along."""
    kept = review.where(excerpt_source() != "").select(
        "forum_id", F.coalesce(F.col("note_id").cast("string"), F.lit("")).alias("note_id"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        L.rating_designation().alias("rating_designation"),
        L.designated_rating().alias("rating_value"))
    return without(kept, held_out)


def candidates(forum: DataFrame, review: DataFrame, response: DataFrame,
               held_out: DataFrame | None = None, scratch: str | None = None) -> DataFrame:
    """Candidate reviews with their category on each of the five axes.

    Rating cuts come from all candidates; the disagreement split comes from all
    forums of the corpus, held-out ones included. Both are one-row aggregates. With a
    ``scratch`` folder the narrow candidate table is written there first, so the texts,
    which only decide who is a candidate, are read once."""
    rated = rated_candidates(review, held_out)
    if scratch is not None:
        rated.write.mode("overwrite").parquet(f"{scratch}/candidates")
        rated = rated.sparkSession.read.schema(rated.schema).parquet(f"{scratch}/candidates")
    cuts = O.tercile_cuts(O.histogram(rated, [], "rating_value"), [], "rating_value")
    per_forum = with_row(
        forum.select("forum_id", "venue_year", "decision")
        .join(rating_ranges(review), "forum_id", "left")
        .join(response_counts(response), "forum_id", "left"),
        median_range(review),
    ).select(
        "forum_id",
        L.decision_bucket().alias("decision_bucket"),
        L.year_label().alias("year"),
        F.when(F.col("rating_range").isNull(), "insufficient_data")
        .when(F.col("rating_range") > F.col("median"), "high").otherwise("low")
        .alias("disagreement_bucket"),
        F.when(F.col("n_responses") > 0, "present").otherwise("absent")
        .alias("rebuttal_bucket"),
    )
    return (
        with_row(rated.join(per_forum, "forum_id"), cuts)
        .withColumn("rating_bucket", L.tercile_bucket("rating_value", "low_cut", "high_cut"))
        .drop("low_cut", "high_cut")
    )


def by_axis(cands: DataFrame, axes=S.EVIDENCE_AXES) -> DataFrame:
    """One row per candidate and axis."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in axes])
    return cands.withColumn("_x", F.explode(pairs)).select("*", "_x.axis", "_x.category").drop("_x")


def stratified_sample(cands: DataFrame, seed: int, per_bucket: int = S.EVIDENCE_PER_BUCKET,
                      axes=S.EVIDENCE_AXES) -> DataFrame:
    """Up to ``per_bucket`` candidates of every category of every axis.

    Reviews of a forum under one note id, or without any, are one candidate, so keys are
    unique and quotas exact. The cutoffs do not depend on how large a category is."""
    one = O.latest(cands, ["forum_id", "note_id"], [
        F.col("content_hash"), F.col("rating_designation"), F.col("rating_value")])
    rows = by_axis(one, axes).withColumn(
        "_key", seeded_key(seed, "axis", "category", "forum_id", "note_id"))
    group = ["axis", "category"]
    cutoffs = O.key_cutoffs(rows, group, "_key", lambda sizes: sizes.withColumn(
        "quota", F.least("size", F.lit(per_bucket))))
    return rows.join(cutoffs, group).where(F.col("_key") <= F.col("cutoff")).drop("_key", "cutoff")


def cap(df: DataFrame, seed: int, max_items: int, *identity: str) -> DataFrame:
    """Seeded sample of at most ``max_items`` rows; a bound, not a rebalancing."""
    key = seeded_key(seed, F.lit("cap"), *identity)
    return df.orderBy(key, *identity).limit(max_items)


def select_evidence(forum: DataFrame, review: DataFrame, response: DataFrame, *, seed: int,
                    max_items: int = S.EVIDENCE_MAX_ITEMS,
                    per_bucket: int = S.EVIDENCE_PER_BUCKET,
                    held_out: DataFrame | None = None,
                    scratch: str | None = None) -> DataFrame:
    """The evidence bundle. Same seed and corpus give the same bundle on any cluster.

    Sampling works on identifiers and categories; text is read only for the selected
    reviews. A review chosen on several axes appears once."""
    if max_items < 0 or per_bucket < 0:
        raise ValueError("max_items and per_bucket must be non-negative")
    if isinstance(review.schema["text"].dataType, StructType):
        raise ValueError("evidence needs the full-text tier, not the redacted one")
    cands = candidates(forum, review, response, held_out, scratch)
    picked = (
        stratified_sample(cands, seed, per_bucket)
        .drop("axis", "category")
        .dropDuplicates(["forum_id", "note_id"])
    )
    picked = cap(picked, seed, max_items, "forum_id", "note_id")
    texts = review.select(
        "forum_id", F.coalesce(F.col("note_id").cast("string"), F.lit("")).alias("note_id"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"), excerpt_source().alias("source"))
    facts = forum.select("forum_id", "venue_family", "decision", "url")
    # Reviews without an id share one evidence id; the sampled one of them stands for it.
    found = O.latest(
        texts.where(F.col("source") != "").join(picked, ["forum_id", "note_id", "content_hash"]),
        ["forum_id", "note_id"], [F.col("source")])
    return (
        found
        .join(facts, "forum_id")
        .select(
            evidence_id().alias("evidence_id"),
            "venue_family", F.col("year").alias("venue_year"), "forum_id", "note_id",
            F.col("url").alias("source_url"), "rating_designation", "rating_value",
            L.decision_label().alias("decision"), "content_hash",
            F.substring("source", 1, S.EVIDENCE_EXCERPT_CHARS).alias("excerpt_text"),
            F.length("source").alias("excerpt_length"),
            *[a for a in S.EVIDENCE_AXES if a != "year"],
        )
    )


def with_strata(items: DataFrame) -> DataFrame:
    """Fold the axis columns into a map, the export shape."""
    cols = {a: F.col("venue_year" if a == "year" else a) for a in S.EVIDENCE_AXES}
    return items.withColumn("strata", F.map_from_arrays(
        F.array(*[F.lit(a) for a in cols]), F.array(*cols.values()))).drop(
        *[a for a in S.EVIDENCE_AXES if a != "year"])


def bundle_header(items: DataFrame, *, seed: int, corpus_hash: str, generated_at: str) -> DataFrame:
    """One row: count and hash of the selected ids, independent of their order."""
    bundle = id_digest(items, "evidence_id", name="bundle_hash")
    return with_row(bundle, items.agg(F.count(F.lit(1)).alias("count"))).withColumns({
            "seed": F.lit(seed), "corpus_hash": F.lit(corpus_hash),
            "generated_at": F.lit(generated_at),
            "schema_version": F.lit(S.EVIDENCE_SCHEMA_VERSION)})


# --- checks -----------------------------------------------------------------------------


def explode_rules(df: DataFrame, entity: Column | str,
                  rules: list[tuple[str, Column, Column | str | None]]) -> DataFrame:
    """Violation rows of several row-local rules in a single pass over ``df``."""
    checks = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce((F.lit("") if d is None else F.col(d) if isinstance(d, str) else d)
                       .cast("string"), F.lit("")).alias("detail")))
        for rule, test, d in rules]))
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.select(entity.alias("_e"), F.explode(checks).alias("_v")).select(
        *L.violation("_e", F.col("_v.rule"), F.col("_v.detail")))


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    """One row per repeated key; ``n`` counts its second and later occurrences."""
    return (
        df.where(~is_blank(F.col(key).cast("string"))).groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        .select(*L.violation(key, rule, n=F.col("_n") - 1))
    )


def validate_bundle(items: DataFrame, forum: DataFrame, review: DataFrame,
                    held_out: DataFrame | None = None) -> DataFrame:
    """Every violation of an evidence bundle against its source corpus.

    A missing forum or note suppresses the checks that would need it, and the excerpt
    is only compared when the hash says the source text is unchanged. Items without a note
    id match no review, and a note id that occurs twice in a forum is looked up once."""
    f = forum.select(F.col("forum_id"), F.col("venue_family").alias("_family"),
                     L.year_label().alias("_year"), F.lit(True).alias("_forum"))
    r = (
        review.where(F.trim(F.col("note_id").cast("string")) != "")
        .groupBy("forum_id", F.col("note_id").cast("string").alias("note_id"))
        .agg(F.min(F.struct(F.col("content_hash").alias("_hash"), excerpt_source().alias("_source"))).alias("_r"))
        .select("forum_id", "note_id", "_r.*", F.lit(True).alias("_note"))
    )
    joined = items.join(f, "forum_id", "left").join(r, ["forum_id", "note_id"], "left")
    if held_out is not None:
        h = held_out.select("forum_id").distinct().withColumn("_held", F.lit(True))
        joined = joined.join(h, "forum_id", "left")
    else:
        joined = joined.withColumn("_held", F.lit(False))
    known, found = F.col("_forum").isNotNull(), F.col("_note").isNotNull()
    same = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))
    claimed = F.concat_ws("/", "venue_family", F.col("venue_year").cast("string"))
    actual = F.concat_ws("/", "_family", "_year")
    rules = [
        (f"missing_field.{c}", is_blank(F.col(c).cast("string")), None) for c in REQUIRED_FIELDS
    ] + [
        ("unknown_forum", ~known, F.col("forum_id").cast("string")),
        ("unknown_note", known & ~found, "note_id"),
        ("content_hash_mismatch", found & ~same, None),
        ("excerpt_not_prefix", found & same & ~F.startswith("_source", "excerpt_text"), None),
        ("venue_year_mismatch", found & ~claimed.eqNullSafe(actual),
         F.concat_ws(" vs ", claimed, actual)),
        ("held_out_overlap", found & F.coalesce("_held", F.lit(False)),
         F.col("forum_id").cast("string")),
    ]
    return explode_rules(joined, "evidence_id", rules).unionByName(
        duplicates(items, "evidence_id", "duplicate_evidence_id"))


def union_violations(parts: list[DataFrame], source: str | None = None) -> DataFrame:
    out = reduce(DataFrame.unionByName, parts)
    return out if source is None else out.withColumn("source", F.lit(source))
