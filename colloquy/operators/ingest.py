"""From raw notes and legacy dumps to forum, review and response tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import notes as N
from colloquy.functions.hashing import response_hash, review_hash
from colloquy.functions.text import year_of
from colloquy.operators.order_stats import latest
from colloquy.sources.json_document import json_elements


@dataclass
class Corpus:
    """The three flat tables. ``review`` and ``response`` may be arbitrarily skewed."""

    forum: DataFrame
    review: DataFrame
    response: DataFrame


# --- note parsing -----------------------------------------------------------------------


def classified(notes: DataFrame) -> DataFrame:
    """Notes with parsed content and their kind."""
    inv = N.note_invitation()
    return notes.withColumns({
        "body": N.parse_content("content"),
        "inv": inv,
        "kind": N.classify_invitation(inv),
        "modified_at": N.note_modified_at(),
    })


def parse_reviews(notes: DataFrame) -> DataFrame:
    """Review rows from classified notes."""
    return (
        notes.where(F.col("kind") == "review")
        .select(F.col("forum").alias("forum_id"), F.col("id").alias("note_id"),
                F.col("inv").alias("invitation"), *N.review_columns(F.col("body")), "modified_at")
        .withColumn("content_hash", review_hash())
    )


def parse_responses(notes: DataFrame) -> DataFrame:
    """Response rows; every author or committee note counts as a rebuttal."""
    return (
        notes.where(F.col("kind") == "rebuttal")
        .select(F.col("forum").alias("forum_id"), F.col("id").alias("note_id"),
                F.lit("rebuttal").alias("kind"), N.response_text(F.col("body")).alias("text"),
                "modified_at")
        .withColumn("content_hash", response_hash())
    )


def note_decisions(notes: DataFrame, order: list[Column]) -> DataFrame:
    """One decision per forum; the last decision note wins. ``order`` ranks notes from
    first to last and ends with a unique column."""
    raw = N.decision_text(F.col("body"))
    return (
        notes.where(F.col("kind") == "decision")
        .groupBy(F.col("forum").alias("forum_id"))
        .agg(F.max_by(F.struct(raw.alias("raw"), F.col("id").alias("id")), F.struct(*order)).alias("d"))
        .select("forum_id", N.decision(F.col("d.raw"), F.col("d.id")).alias("note_decision"))
    )


def parse_papers(papers: DataFrame) -> DataFrame:
    """Forum rows from submission notes. A decided venue id outranks decision notes."""
    body = F.col("body")
    return papers.withColumn("body", N.parse_content("content")).select(
        F.coalesce(F.nullif("id", F.lit("")), "forum").alias("forum_id"),
        N.paper(body).alias("paper"),
        N.decision_from_venueid(N.field_text(body, "venueid"), N.field_text(body, "venue"))
        .alias("venueid_decision"),
    )


def no_decision() -> Column:
    return F.struct(F.lit("").alias("raw_text"), F.lit("").alias("normalized"),
                    F.lit("").alias("category"), F.lit(None).cast("string").alias("note_id"))


def unseen_refresh() -> Column:
    return F.struct(
        F.lit("unseen").alias("status"), F.lit(None).cast("string").alias("terminal_reason"),
        F.lit(None).cast("double").alias("last_checked_at"), F.lit(0).alias("refresh_attempts"),
        F.lit(None).cast("double").alias("next_refresh_at"))


def assemble(papers: DataFrame, children: DataFrame, *, venue_family: Column, venue_id: Column,
             venue_year: Column, api_version: Column, fetched_at: Column, order: list[Column],
             sampling_method: str = "acquisition", sampling_seed: int | None = None) -> Corpus:
    """Build the corpus tables from submission notes and their child notes.

    The only join is forum to its decision, after decisions were reduced to one row
    per forum on the map side. Reviews and responses stay flat."""
    notes = classified(children)
    forum = (
        parse_papers(papers)
        .join(note_decisions(notes, order), "forum_id", "left")
        .select(
            "forum_id",
            F.concat(F.lit(S.FORUM_URL_PREFIX), "forum_id").alias("url"),
            venue_family.cast("string").alias("venue_family"),
            venue_id.cast("string").alias("venue_id"),
            venue_year.cast("int").alias("venue_year"),
            api_version.cast("string").alias("api_version"),
            "paper",
            F.coalesce("venueid_decision", "note_decision", no_decision()).alias("decision"),
            F.lit(S.SCHEMA_VERSION).alias("schema_version"),
            fetched_at.cast("double").alias("fetched_at"),
            F.lit(S.PRODUCER_VERSION).alias("producer_version"),
            F.lit(sampling_method).alias("sampling_method"),
            F.lit(sampling_seed).cast("int").alias("sampling_seed"),
            F.array().cast("array<string>").alias("retrieval_errors"),
            unseen_refresh().alias("refresh"),
        )
    )
    return Corpus(forum, parse_reviews(notes), parse_responses(notes))


# --- legacy dumps -----------------------------------------------------------------------


LEGACY_REVIEW = (
    "struct<forum_id:string,note_id:string,rating:string,rating_num:double,"
    "confidence:string,summary:string,text:string,strengths:string,weaknesses:string,"
    "questions:string>")
LEGACY_REVIEWS = f"array<{LEGACY_REVIEW}>"


def explode_legacy(dumps: DataFrame, json: str = "json", order: str = "dump_order") -> DataFrame:
    """Rows of legacy dumps, JSON objects ``{display name: [review, ...]}``. Entries
    that are not lists, internal ``_forum_`` entries and rows without a forum id are
    skipped. ``dump_order``, the place of the name in the document and the position in
    the list fix what comes first."""
    entries = dumps.select(
        F.col(order).alias("_dump"), F.json_object_keys(json).alias("_names"),
        F.explode(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))
        .alias("display_name", "entry"),
    ).where(~F.col("display_name").startswith("_forum_"))
    rows = entries.select(
        "_dump", F.array_position("_names", F.col("display_name")).alias("_place"), "display_name",
        F.posexplode(F.try_variant_get("entry", "$", LEGACY_REVIEWS)).alias("_pos", "r"))
    return _legacy_reviews(rows)


def read_legacy(spark: SparkSession, path: str, split_bytes: int = 128 << 20, parts: bool = False, cut: bool = False) -> DataFrame:
    """The rows of `explode_legacy` from dump files, or folders of parts of them, read by as many tasks as they have splits."""
    elements = json_elements(spark, path, split_bytes, parts, cut).where(~F.col("key").startswith("_forum_"))
    review = F.try_variant_get(F.try_parse_json("json"), "$", LEGACY_REVIEW)
    return _legacy_reviews(elements.select(
        F.col("file").alias("_dump"), F.col("place").alias("_place"), F.col("key").alias("display_name"),
        F.col("position").alias("_pos"), F.explode(F.array(review)).alias("r")))  # no filter goes below: parsed once


def _legacy_reviews(rows: DataFrame) -> DataFrame:
    text = lambda k: F.coalesce(f"r.{k}", F.lit(""))
    return rows.where(text("forum_id") != "").select(
        "_dump", "_place", "display_name", "_pos", "r.forum_id", "r.note_id",
        text("rating").alias("rating_raw"), F.col("r.rating_num").alias("initial_value"),
        text("confidence").alias("confidence_raw"),
        *[text(k).alias(k) for k in ("summary", "text", "strengths", "weaknesses", "questions")],
    )


def legacy_families(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Add family (registry look-up, else 'unknown') and year of the display name.
    The registry has one row per venue and is broadcast, so the reviews are not shuffled by
    the few names."""
    names = registry.select("display_name", F.col("family").alias("_fam"))
    return rows.join(F.broadcast(names), "display_name", "left").withColumns({
        "venue_family": F.coalesce("_fam", F.lit("unknown")),
        "venue_year": year_of("display_name"),
    }).drop("_fam")


def migrate_legacy(dumps: DataFrame, registry: DataFrame) -> Corpus:
    """Legacy dumps to corpus tables. Per family and forum the first review of a note
    id wins; reviews without a note id are all kept."""
    return migrated(explode_legacy(dumps), registry)


def migrated(reviews: DataFrame, registry: DataFrame) -> Corpus:
    """Corpus tables of the rows of `explode_legacy` or `read_legacy`."""
    rows = legacy_families(reviews, registry)
    first = [F.col("_dump"), F.col("_place"), F.col("display_name"), F.col("_pos")]
    forum = (
        rows.groupBy("venue_family", "forum_id")
        .agg(F.min_by(F.struct("display_name", "venue_year"), F.struct(*first)).alias("v"))
        .select(
            "forum_id", F.concat(F.lit(S.FORUM_URL_PREFIX), "forum_id").alias("url"),
            "venue_family", F.col("v.display_name").alias("venue_id"),
            F.col("v.venue_year").alias("venue_year"), F.lit("unknown").alias("api_version"),
            no_decision().alias("decision"), F.lit("migrated_legacy").alias("sampling_method"),
        )
    )
    identity = F.when(
        F.coalesce("note_id", F.lit("")) != "", F.concat(F.lit("id "), "note_id")
    ).otherwise(F.concat_ws(" ", F.lit("row"), *first))
    key = ["venue_family", "forum_id", "_key"]  # behind its hash: sorts compare one number, not three texts
    review = (
        latest(rows.withColumn("_key", identity).withColumn("_hash", F.xxhash64(*key)), ["_hash", *key], first)
        .drop("_dump", "_place", "_pos", "_key", "_hash", "display_name")
        .withColumn("content_hash", review_hash())
    )
    none = rows.select("forum_id").where(F.lit(False))
    return Corpus(forum, review, none)


# --- keyed maintenance ------------------------------------------------------------------


def latest_version(forums: DataFrame, version: str = "fetched_at", *tie: str) -> DataFrame:
    """One record per forum id: the one with the highest version."""
    return latest(forums, ["forum_id"], [F.col(c).desc_nulls_last() for c in (version, *tie)])


def upsert(current: DataFrame, incoming: DataFrame, version: str = "fetched_at",
           *tie: str) -> DataFrame:
    """Replace by key; on equal versions the incoming record wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, ["forum_id"], [
        F.col(version).desc_nulls_last(), F.col("_new").desc(),
        *[F.col(t).desc_nulls_last() for t in tie]]).drop("_new")


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "forum_id") -> DataFrame:
    """Candidates whose key is not in ``seen``."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def changed_forums(old: DataFrame, new: DataFrame, key: str = "forum_id",
                   value: str = "content_hash") -> DataFrame:
    """Forum ids whose multiset of review hashes differs between two versions.

    Counted per (forum, hash) rather than compared as sorted lists, so no forum is
    ever gathered into one array."""
    signed = old.select(key, value, F.lit(1).alias("_d")).unionAll(
        new.select(key, value, F.lit(-1).alias("_d")))
    return (
        signed.groupBy(key, value).agg(F.sum("_d").alias("_d"))
        .where(F.col("_d") != 0).select(key).distinct()
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per venue: new, refreshed and failed forums and the run status."""
    is_ = lambda k: F.count_if(F.col("outcome") == k)
    return outcomes.groupBy("venue").agg(
        is_("new").alias("new"), is_("refreshed").alias("refreshed"), is_("error").alias("errors"),
    ).withColumn("status", F.when(F.col("errors") > 0, "partial").otherwise("ok"))


def parse_run_log(lines: DataFrame, marker: str, order: str = "line_no",
                  text: str = "line") -> DataFrame:
    """Summary rows from the last line of a log that starts with ``marker``."""
    last = lines.where(F.col(text).startswith(marker)).agg(F.max_by(text, order).alias("s"))
    body = F.substring(F.col("s"), len(marker) + 1, 2**31 - 1)
    entry = "array<struct<venue:string,status:string,new:bigint,refreshed:bigint,errors:bigint>>"
    return last.select(F.explode(F.from_json(body, entry)).alias("e")).select("e.*")


def venue_entries(registry: DataFrame, families: list[str] | None = None,
                  years: list[int] | None = None) -> DataFrame:
    """Registry rows of the wanted families and years. A venue without a year passes
    every year filter."""
    tests = [F.lit(True)]
    if families:
        tests.append(F.col("family").isin([f.lower() for f in families]))
    if years:
        tests.append(F.col("year").isin(years) | F.col("year").isNull())
    return registry.where(reduce(lambda a, b: a & b, tests))
