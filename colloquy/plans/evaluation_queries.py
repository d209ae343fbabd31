"""Queries C1-C4, W4-W5, K1-K5, U1-U3, Q1, Q3-Q8, A15-A26, J5-J10, J13, J17-J18:
evidence, splits, prediction runs and scores."""

import re

from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions.hashing import seeded_key
from colloquy.functions.rows import with_row
from colloquy.operators import evaluation as EV
from colloquy.operators import evidence as E
from colloquy.operators import runs as R
from colloquy.operators import scoring as SC
from colloquy.operators import split as SP
from colloquy.operators.order_stats import top_k
from colloquy.plans.ingest_queries import one_document
from colloquy.plans.registry import CTES, cte, query
from colloquy.sources import driver_tables as D
from colloquy.sources.corpus import canonical_order, scratch_dir

DIGITS = 10
SEED = 42


# --- evidence ---------------------------------------------------------------------------

cte("held_out", "SELECT forum_id FROM dforum WHERE venue_family = 'es'")
cte("dranges", """
  SELECT forum_id, max(initial_value) - min(initial_value) AS rng FROM dreview
  GROUP BY forum_id HAVING count(initial_value) >= 2
""")
cte("dcand", """
  SELECT r.*, coalesce(final_value, initial_value) AS rating_value,
    CASE WHEN final_value IS NOT NULL THEN 'final' ELSE 'initial' END AS rating_designation
  FROM dhash r WHERE source_text <> '' AND forum_id NOT IN (SELECT forum_id FROM held_out)
""")
cte("dcuts", """
  SELECT vs[len(vs) // 3 + 1] AS lo, vs[2 * len(vs) // 3 + 1] AS hi
  FROM (SELECT list_sort(list(rating_value)) AS vs FROM dcand WHERE rating_value IS NOT NULL)
""")
cte("dtagged", """
  SELECT c.*, f.url, f.venue_family, CAST(f.venue_year AS VARCHAR) AS "year", f.decision,
    CASE f.decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'unknown' END AS decision_bucket,
    CASE WHEN rating_value IS NULL THEN 'unknown' WHEN rating_value < lo THEN 'low'
      WHEN rating_value > hi THEN 'high' ELSE 'medium' END AS rating_bucket,
    CASE WHEN g.rng IS NULL THEN 'insufficient_data'
      WHEN g.rng > (SELECT median(rng) FROM dranges) THEN 'high' ELSE 'low' END AS disagreement_bucket,
    CASE WHEN c.forum_id IN (SELECT forum_id FROM dresponse) THEN 'present' ELSE 'absent' END AS rebuttal_bucket
  FROM dcand c JOIN dforum f USING (forum_id) LEFT JOIN dranges g USING (forum_id), dcuts
""")
cte("dpicked", """
  SELECT DISTINCT forum_id, note_id FROM (
    SELECT forum_id, note_id, row_number() OVER (PARTITION BY axis, category
      ORDER BY sha256('42|' || axis || '|' || category || '|' || forum_id || '|' || note_id), forum_id, note_id) AS rn
    FROM (
      SELECT forum_id, note_id, 'decision_bucket' AS axis, decision_bucket AS category FROM dtagged
      UNION ALL SELECT forum_id, note_id, 'rating_bucket', rating_bucket FROM dtagged
      UNION ALL SELECT forum_id, note_id, 'year', "year" FROM dtagged
      UNION ALL SELECT forum_id, note_id, 'disagreement_bucket', disagreement_bucket FROM dtagged
      UNION ALL SELECT forum_id, note_id, 'rebuttal_bucket', rebuttal_bucket FROM dtagged)
  ) WHERE rn <= 4
""")
cte("devidence", """
  SELECT 'ev_' || substr(sha256(forum_id || chr(0) || note_id || chr(0) || rating_designation || chr(0)), 1, 16) AS evidence_id,
    venue_family, "year" AS venue_year, forum_id, note_id, url AS source_url, rating_designation, rating_value,
    decision, content_hash, substr(source_text, 1, 600) AS excerpt_text,
    CAST(length(source_text) AS INTEGER) AS excerpt_length,
    decision_bucket, rating_bucket, disagreement_bucket, rebuttal_bucket
  FROM dtagged JOIN (SELECT * FROM dpicked
    ORDER BY sha256('42|cap|' || forum_id || '|' || note_id), forum_id, note_id LIMIT 40) USING (forum_id, note_id)
""")


def _held_out(spark, path):
    return D.document_forums(spark, path).where(F.col("venue_family") == "es").select("forum_id")


def evidence(spark, path):
    c = D.documents_corpus(spark, path)
    return E.select_evidence(c.forum, c.review, c.response, seed=SEED, max_items=40,
                             held_out=_held_out(spark, path), scratch=scratch_dir(spark))


query("C1_select_evidence", "SELECT * FROM devidence")(evidence)


@query("F16_evidence_candidates_with_strata", """
  SELECT forum_id, note_id, rating_designation, rating_value, "year", decision_bucket, rating_bucket,
    disagreement_bucket, rebuttal_bucket FROM dtagged""")
def f16(spark, path):
    c = D.documents_corpus(spark, path)
    return E.candidates(c.forum, c.review, c.response, _held_out(spark, path)).drop("content_hash")


@query("W4_U1_stratified_sample_over_axes", "SELECT forum_id, note_id FROM dpicked")
def w4(spark, path):
    c = D.documents_corpus(spark, path)
    cands = E.candidates(c.forum, c.review, c.response, _held_out(spark, path), scratch_dir(spark))
    return E.stratified_sample(cands, SEED).select("forum_id", "note_id").distinct()


@query("W4_large_quota_with_missing_and_repeated_ids", """
  SELECT * FROM (WITH one AS (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY forum_id, id
        ORDER BY content_hash, rating_designation, rating_value NULLS FIRST) AS nth
      FROM (SELECT *, CASE WHEN length(text) % 7 = 0 THEN '' WHEN length(text) % 11 = 0 THEN 'same' ELSE note_id END AS id
        FROM dtagged)) WHERE nth = 1)
  SELECT axis, category, forum_id, id AS note_id FROM (
    SELECT *, row_number() OVER (PARTITION BY axis, category
      ORDER BY sha256('42|' || axis || '|' || category || '|' || forum_id || '|' || id)) AS rn
    FROM (
      SELECT forum_id, id, 'decision_bucket' AS axis, decision_bucket AS category FROM one
      UNION ALL SELECT forum_id, id, 'rating_bucket', rating_bucket FROM one
      UNION ALL SELECT forum_id, id, 'year', "year" FROM one
      UNION ALL SELECT forum_id, id, 'disagreement_bucket', disagreement_bucket FROM one
      UNION ALL SELECT forum_id, id, 'rebuttal_bucket', rebuttal_bucket FROM one)
  ) WHERE rn <= 1001)""")
def w4_large(spark, path):
    c, size = D.documents_corpus(spark, path), F.length("text")
    review = c.review.withColumn("note_id", F.when(size % 7 == 0, F.lit(None)).when(size % 11 == 0, "same")
                                 .otherwise(F.col("note_id")))
    cands = E.candidates(c.forum, review, c.response, _held_out(spark, path), scratch_dir(spark))
    return E.stratified_sample(cands, SEED, 1001).select("axis", "category", "forum_id", "note_id")


@query("K2_seeded_cap", """
  SELECT o_orderkey FROM orders ORDER BY sha256('7|cap|' || o_orderkey), o_orderkey LIMIT 100""")
def k2(spark, path):
    return E.cap(D.table(spark, path, "orders").select("o_orderkey"), 7, 100, "o_orderkey")


@query("K1_canonical_order", """
  SELECT venue_family, venue_year, forum_id FROM scoped ORDER BY venue_family, venue_year, forum_id""")
def k1(spark, path):
    from colloquy.operators.statistics import scoped_forums

    forums = scoped_forums(D.order_forums(spark, path, False)).drop("decision")
    return canonical_order(forums)


@query("K4_next_unseen_per_venue", """
  SELECT venue_family, forum_id FROM (
    SELECT venue_family, forum_id, row_number() OVER (PARTITION BY venue_family ORDER BY fetched_at, forum_id) AS rn
    FROM forum WHERE forum_id NOT IN (SELECT forum_id FROM calibration)) WHERE rn <= 20""")
def k4(spark, path):
    from colloquy.operators.ingest import unseen
    from colloquy.streaming.acquisition import next_unseen

    f = D.order_forums(spark, path, False).select("venue_family", "forum_id", "fetched_at")
    return next_unseen(unseen(f, D.calibration_ids(spark, path)), 20, ["venue_family"],
                       created="fetched_at").select("venue_family", "forum_id")


@query("K4_seeded_page_per_venue", """
  SELECT venue_family, forum_id FROM (
    SELECT venue_family, forum_id, row_number() OVER (PARTITION BY venue_family
      ORDER BY sha256('42|' || forum_id), forum_id) AS rn FROM forum) WHERE rn <= 20""")
def k4b(spark, path):
    f = D.order_forums(spark, path, False).select("venue_family", "forum_id")
    return top_k(f, ["venue_family"], [seeded_key(SEED, "forum_id"), F.col("forum_id")], 20)


@query("K5_first_inputs", """
  SELECT forum_id, title FROM forum ORDER BY forum_id LIMIT 50""")
def k5(spark, path):
    return D.order_forums(spark, path).select("forum_id", "title").orderBy("forum_id").limit(50)


cte("item", """
  SELECT CASE WHEN length(content_hash || note_id) % 11 = 0 THEN 'ev_same' ELSE 'ev_' || note_id END AS evidence_id,
    CASE WHEN h % 7 = 0 THEN 'zz' ELSE venue_family END AS venue_family,
    CAST(venue_year AS VARCHAR) AS venue_year,
    CASE WHEN h % 13 = 0 THEN 'no/where' ELSE forum_id END AS forum_id,
    CASE WHEN h % 5 = 0 THEN 'd?' ELSE note_id END AS note_id,
    url AS source_url, 'initial' AS rating_designation, decision,
    CASE WHEN h % 17 = 0 THEN 'stale' ELSE content_hash END AS content_hash, '' AS corpus_hash,
    CASE WHEN h % 3 = 0 THEN 'x' || substr(source_text, 1, 600) ELSE substr(source_text, 1, 600) END AS excerpt_text
  FROM (SELECT r.*, f.venue_family, f.venue_year, f.url, f.decision, length(r.text) AS h
    FROM dhash r JOIN dforum f USING (forum_id))
""")


def _items(spark, path):
    """Every review as an evidence item, tampered with by text length."""
    c = D.documents_corpus(spark, path)
    h = F.length("text")
    return c.review.join(c.forum.select("forum_id", "venue_family", "venue_year", "url", "decision"), "forum_id").select(
        F.when(F.length(F.concat("content_hash", "note_id")) % 11 == 0, "ev_same")
        .otherwise(F.concat(F.lit("ev_"), "note_id")).alias("evidence_id"),
        F.when(h % 7 == 0, "zz").otherwise(F.col("venue_family")).alias("venue_family"),
        F.col("venue_year").cast("string").alias("venue_year"),
        F.when(h % 13 == 0, "no/where").otherwise(F.col("forum_id")).alias("forum_id"),
        F.when(h % 5 == 0, "d?").otherwise(F.col("note_id")).alias("note_id"),
        F.col("url").alias("source_url"), F.lit("initial").alias("rating_designation"), "decision",
        F.when(h % 17 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
        F.lit("").alias("corpus_hash"),
        F.concat(F.when(h % 3 == 0, "x").otherwise(""),
                 F.substring(E.excerpt_source(), 1, 600)).alias("excerpt_text"))


@query("Q1_J10_validate_evidence_bundle", """
  SELECT * FROM (WITH j AS (
    SELECT i.*, f.forum_id IS NOT NULL AS known, r.note_id IS NOT NULL AS found,
      f.venue_family || '/' || f.venue_year AS actual, r.content_hash AS h, r.source_text,
      i.forum_id IN (SELECT forum_id FROM held_out) AS held
    FROM item i LEFT JOIN dforum f ON i.forum_id = f.forum_id
    LEFT JOIN dhash r ON i.forum_id = r.forum_id AND i.note_id = r.note_id)
  SELECT evidence_id AS entity_id, 'missing_field.corpus_hash' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM j
  UNION ALL SELECT evidence_id, 'unknown_forum', forum_id, 1 FROM j WHERE NOT known
  UNION ALL SELECT evidence_id, 'unknown_note', note_id, 1 FROM j WHERE known AND NOT found
  UNION ALL SELECT evidence_id, 'content_hash_mismatch', '', 1 FROM j WHERE found AND h <> content_hash
  UNION ALL SELECT evidence_id, 'excerpt_not_prefix', '', 1 FROM j
    WHERE found AND h = content_hash AND NOT starts_with(source_text, excerpt_text)
  UNION ALL SELECT evidence_id, 'venue_year_mismatch', venue_family || '/' || venue_year || ' vs ' || actual, 1
    FROM j WHERE found AND venue_family || '/' || venue_year <> actual
  UNION ALL SELECT evidence_id, 'held_out_overlap', forum_id, 1 FROM j WHERE found AND held
  UNION ALL SELECT evidence_id, 'duplicate_evidence_id', '', count(*) - 1 FROM j GROUP BY 1 HAVING count(*) > 1)
""")
def q1(spark, path):
    c = D.documents_corpus(spark, path)
    return E.validate_bundle(_items(spark, path), c.forum, c.review, _held_out(spark, path))


# --- labels and splits ------------------------------------------------------------------

cte("label", """
  SELECT f.forum_id, CASE WHEN venue_family = '' THEN 'unknown' ELSE venue_family END AS venue_family,
    coalesce(CAST(venue_year AS VARCHAR), 'unspecified') AS venue_year,
    CASE WHEN n_rated > 0 THEN sum_v / n_rated END AS initial_rating_target,
    'mean_of_initial_ratings' AS initial_rating_aggregation, coalesce(n_rated, 0) AS initial_rating_n,
    coalesce(n_rated, 0) > 0 AS initial_rating_eligible,
    CASE WHEN decision IN ('accept', 'reject') THEN decision END AS final_decision_target,
    decision_raw AS final_decision_raw, decision IN ('accept', 'reject') AS final_decision_eligible,
    CASE decision WHEN 'withdrawn' THEN 'withdrawn' WHEN 'desk_reject' THEN 'desk_reject'
      WHEN 'unknown' THEN 'unresolved' END AS final_decision_excluded_reason
  FROM forum f LEFT JOIN per_forum USING (forum_id)
""")
cte("screened", """
  SELECT l.forum_id, l.venue_family, l.venue_year,
    CASE WHEN l.forum_id IN (SELECT forum_id FROM calibration) THEN 'in_calibration_set'
      WHEN NOT initial_rating_eligible AND NOT final_decision_eligible THEN 'no_usable_labels'
      WHEN coalesce(title, '') = '' AND coalesce(abstract, '') = '' THEN 'missing_paper_content' END AS reason
  FROM label l JOIN forum f ON l.forum_id = f.forum_id
""")
cte("quota", """
  SELECT *, CASE WHEN total <= 500 THEN size ELSE base + CASE WHEN rk <= 500 - sum_base THEN 1 ELSE 0 END END AS quota
  FROM (SELECT *, sum(base) OVER () AS sum_base,
      row_number() OVER (ORDER BY rem DESC, venue_family, venue_year) AS rk
    FROM (SELECT *, (size * 500) // total AS base, (size * 500) % total AS rem
      FROM (SELECT venue_family, venue_year, count(*) AS size, sum(count(*)) OVER () AS total
        FROM screened WHERE reason IS NULL GROUP BY 1, 2)))
""")
cte("split", """
  SELECT s.forum_id, s.venue_family, s.venue_year, CASE WHEN s.reason IS NOT NULL THEN s.reason
    WHEN k.forum_id IS NULL THEN 'subsampled_out' END AS reason
  FROM screened s LEFT JOIN (
    SELECT forum_id FROM (
      SELECT forum_id, quota, row_number() OVER (PARTITION BY venue_family, venue_year
        ORDER BY sha256('42|' || venue_family || '|' || venue_year || '|' || forum_id)) AS rn
      FROM screened JOIN quota USING (venue_family, venue_year) WHERE reason IS NULL)
    WHERE rn <= quota) k ON s.forum_id = k.forum_id
""")
cte("eval_forum", "SELECT f.* FROM forum f JOIN split s ON f.forum_id = s.forum_id WHERE s.reason IS NULL")


def _corpus(spark, path):
    return D.orders_corpus(spark, path)


def _split(spark, path):
    c = _corpus(spark, path)
    return SP.select_evaluation_forums(
        c.forum, c.review, D.calibration_ids(spark, path), max_forums=500, seed=SEED)


def labels(spark, path):
    c = _corpus(spark, path)
    return SP.private_labels(c.forum, c.review, None)


query("A15_private_labels", "SELECT * FROM label")(labels)


@query("P16_model_inputs", """
  SELECT forum_id, CASE WHEN venue_family = '' THEN 'unknown' ELSE venue_family END AS venue_family,
    coalesce(CAST(venue_year AS VARCHAR), 'unspecified') AS venue_year, coalesce(title, '') AS title,
    coalesce(abstract, '') AS abstract, 'abstract_only' AS input_tier, 1 AS schema_version FROM forum""")
def p16(spark, path):
    return SP.model_inputs(D.order_forums(spark, path))


@query("J5_calibration_exclusion_with_reason", "SELECT * FROM screened")
def j5(spark, path):
    c = _corpus(spark, path)
    return SP.screen(c.forum, c.review, D.calibration_ids(spark, path))


@query("W5_stratified_quotas", """
  SELECT venue_family, venue_year, size, CAST(quota AS BIGINT) AS quota FROM quota""")
def w5(spark, path):
    c = _corpus(spark, path)
    eligible = SP.screen(c.forum, c.review, D.calibration_ids(spark, path)).where(F.col("reason").isNull())
    sizes = eligible.groupBy("venue_family", "venue_year").agg(F.count(F.lit(1)).alias("size"))
    return SP.stratum_quotas(sizes, 500)


query("C2_select_evaluation_forums", "SELECT * FROM split")(_split)


@query("A16_stratification_and_exclusion_counts", """
  SELECT reason AS kind, '' AS venue_family, '' AS venue_year, count(*) AS n FROM split WHERE reason IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'evaluation', venue_family, venue_year, count(*) FROM split WHERE reason IS NULL GROUP BY 2, 3""")
def a16(spark, path):
    s = _split(spark, path)
    excluded = SP.exclusion_counts(s).select(
        F.col("reason").alias("kind"), F.lit("").alias("venue_family"), F.lit("").alias("venue_year"), "n")
    return excluded.unionByName(
        SP.stratify(s.where(F.col("reason").isNull())).withColumn("kind", F.lit("evaluation")))


@query("J6_U3_split_overlap", """
  SELECT o_orderkey AS forum_id FROM orders WHERE o_totalprice > 300000
  INTERSECT SELECT forum_id FROM calibration""")
def j6(spark, path):
    left = D.order_forums(spark, path, False).where(F.col("price") > 300000)
    return SP.overlap(left, D.calibration_ids(spark, path))


cte("dneedle", """
  SELECT forum_id, note_id, 'review.text' AS field, text AS needle FROM dreview
  UNION ALL SELECT forum_id, note_id, 'review.strengths', strengths FROM dreview
  UNION ALL SELECT forum_id, note_id, 'review.weaknesses', weaknesses FROM dreview
  UNION ALL SELECT forum_id, note_id, 'review.questions', questions FROM dreview
  UNION ALL SELECT forum_id, note_id, 'review.summary', summary FROM dreview
  UNION ALL SELECT forum_id, note_id, 'response.text', text FROM dresponse
  UNION ALL SELECT forum_id, '', 'decision.raw_text', decision_raw FROM dforum
""")


@query("J13_Q7_text_leaks", """
  SELECT n.forum_id AS entity_id, 'text_leak' AS rule, field || ':' || note_id AS detail, CAST(1 AS BIGINT) AS n
  FROM dneedle n JOIN dforum f USING (forum_id)
  WHERE length(needle) >= 25 AND contains(lower(title || chr(10) || abstract), lower(needle))""")
def j13(spark, path):
    c = D.documents_corpus(spark, path)
    return SP.text_leaks(SP.model_inputs(c.forum), c.review, c.response, c.forum)


cte("cal_aggregate", f"""
  SELECT count(*) AS calibration_forum_count,
    round(sum(sum_v) / sum(n_rated), {DIGITS}) AS mean_initial_rating,
    CASE WHEN count(*) FILTER (decision = 'accept') > 0 AND count(*) FILTER (decision = 'accept')
      >= count(*) FILTER (decision = 'reject') THEN 'accept'
      WHEN count(*) FILTER (decision = 'reject') > 0 THEN 'reject' END AS majority_decision
  FROM forum LEFT JOIN per_forum USING (forum_id) WHERE segment = 'BUILDING'
""")


@query("A17_reviewer_aggregate_baseline", "SELECT * FROM cal_aggregate")
def a17(spark, path):
    c = _corpus(spark, path)
    return SP.calibration_aggregate(c.forum, c.review, D.calibration_ids(spark, path), DIGITS)


@query("J17_baseline_predictions", """
  SELECT forum_id, 'baseline' AS system, mean_initial_rating AS rating_prediction,
    majority_decision AS decision_prediction, CAST(NULL AS DOUBLE) AS accept_probability
  FROM eval_forum, cal_aggregate""")
def j17(spark, path):
    chosen = _split(spark, path).where(F.col("reason").isNull())
    return SP.baseline_predictions(chosen, a17(spark, path))


INPUT_MEMBERS = ("CAST(forum_id AS VARCHAR) || chr(0) || CASE WHEN venue_family = '' THEN 'unknown' ELSE venue_family END "
                 "|| chr(0) || coalesce(CAST(venue_year AS VARCHAR), 'unspecified') || chr(0) || coalesce(title, '') "
                 "|| chr(0) || coalesce(abstract, '') || chr(0) || 'abstract_only' || chr(0) || '1'")


def _digest(members, source, name):
    from colloquy.plans.ingest_queries import _set_digest_sql

    return "(" + _set_digest_sql(members, source, name) + ")"


cte("inputs_hash", _digest(INPUT_MEMBERS, "eval_forum", "model_inputs_hash"))
cte("calibration_digest", _digest("CAST(forum_id AS VARCHAR)", "calibration", "calibration_hash"))


def _dataset(spark, path):
    """The dataset as a validator meets it: prepared once, then read from its files."""
    c, cal, out = _corpus(spark, path), D.calibration_ids(spark, path), scratch_dir(spark)
    said = F.concat(F.lit("Comment "), "note_id", F.lit(" on submission "), F.col("forum_id").cast("string"))
    SP.prepare_dataset(c.forum, c.review.withColumns(dict.fromkeys(S.REVIEW_TEXTS, said)),
                       c.response.withColumn("text", said), cal, out, seed=SEED, max_forums=500, digits=None)
    return c, cal, SP.load_dataset(spark, out)


@query("C3_prepared_dataset_manifest", """
  SELECT count(*) AS eval_forum_count, count(*) FILTER (initial_rating_eligible) AS initial_rating_eligible_count,
    count(*) FILTER (final_decision_eligible) AS final_decision_eligible_count, 42 AS seed, 1 AS schema_version,
    (SELECT calibration_hash FROM calibration_digest) AS calibration_hash,
    (SELECT corpus_hash FROM corpus_digest) AS corpus_hash,
    (SELECT model_inputs_hash FROM inputs_hash) AS model_inputs_hash
  FROM label WHERE forum_id IN (SELECT forum_id FROM eval_forum)""")
def c3(spark, path):
    return _dataset(spark, path)[2].manifest.drop("private_labels_hash")


def _documents_dataset(spark, path, abstract):
    """A dataset of all documents as reviews and responses, Spanish forums for calibration."""
    c, out = D.documents_corpus(spark, path), scratch_dir(spark)
    forum = c.forum if abstract is None else c.forum.withColumn("abstract", abstract)
    cal = forum.where(F.col("venue_family") == "es").select("forum_id")
    return c, forum, SP.prepare_dataset(forum, c.review, c.response, cal, out, seed=SEED, digits=DIGITS)


@query("C3_documents_dataset_clean", f"""
  SELECT f.forum_id, f.venue_family, 'Texts of ' || f.forum_id AS abstract,
    round(sum(initial_value) / count(initial_value), {DIGITS}) AS initial_rating_target,
    CASE WHEN decision IN ('accept', 'reject') THEN decision END AS final_decision_target
  FROM dforum f LEFT JOIN dreview r USING (forum_id) WHERE f.venue_family <> 'es'
  GROUP BY f.forum_id, f.venue_family, decision HAVING count(initial_value) > 0 OR decision IN ('accept', 'reject')""")
def c3_documents(spark, path):
    """No whole text stands in a title or abstract: the leak check reads all of them and lets the dataset pass."""
    ds = _documents_dataset(spark, path, F.concat(F.lit("Texts of "), "forum_id"))[2]
    return ds.inputs.join(ds.labels, ["forum_id", "venue_family"]).select(
        "forum_id", "venue_family", "abstract", "initial_rating_target", "final_decision_target")


@query("C3_documents_dataset_refused", """
  SELECT DISTINCT n.forum_id AS entity_id FROM dneedle n JOIN dforum f USING (forum_id)
  WHERE f.venue_family <> 'es' AND length(needle) >= 25 AND contains(lower(title || chr(10) || abstract), lower(needle))""")
def c3_refused(spark, path):
    """Abstracts that are documents of their forum leak review texts: no dataset is written."""
    c = D.documents_corpus(spark, path)
    try:
        _documents_dataset(spark, path, None)
    except ValueError as refused:
        if "leaked" not in str(refused):
            raise
        kept = c.forum.where(F.col("venue_family") != "es")
        return SP.text_leaks(SP.model_inputs(kept), c.review, c.response, kept).select("entity_id").distinct()
    raise AssertionError("a dataset with leaks was written")


@query("S9_S10_dataset_written_and_loaded", """
  SELECT l.forum_id, l.venue_family, l.venue_year, coalesce(f.title, '') AS title,
    initial_rating_target, final_decision_target
  FROM label l JOIN eval_forum f USING (forum_id)""")
def s9(spark, path):
    back = _dataset(spark, path)[2]
    return back.inputs.join(back.labels.drop("venue_family", "venue_year"), "forum_id").select(
        "forum_id", "venue_family", "venue_year", "title", "initial_rating_target",
        "final_decision_target")


# --- prediction runs --------------------------------------------------------------------

cte("bad_prediction", """
  SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS forum_id, event_id AS "position",
    CASE WHEN event_type = 'click' THEN 'calibrated' ELSE 'generic' END AS system,
    value AS rating_prediction,
    CASE event_type WHEN 'view' THEN 'accept' WHEN 'error' THEN 'maybe' ELSE NULL END AS decision_prediction,
    value / 50.0 AS accept_probability FROM events
""")


def _bad_predictions(spark, path):
    t = F.col("event_type")
    return D.table(spark, path, "events").select(
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("forum_id"),
        F.col("event_id").alias("position"),
        F.when(t == "click", "calibrated").otherwise("generic").alias("system"),
        F.col("value").alias("rating_prediction"),
        F.when(t == "view", "accept").when(t == "error", "maybe").alias("decision_prediction"),
        (F.col("value") / 50.0).alias("accept_probability"))


LABEL_SQL = "system || ':' || CASE WHEN forum_id = '' THEN '#' || \"position\" ELSE forum_id END"


@query("Q3_prediction_schema_rules", f"""
  SELECT {LABEL_SQL} AS entity_id, 'missing_forum_id' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n
    FROM bad_prediction WHERE forum_id = ''
  UNION ALL SELECT {LABEL_SQL}, 'decision_not_allowed', decision_prediction, 1 FROM bad_prediction WHERE decision_prediction = 'maybe'
  UNION ALL SELECT {LABEL_SQL}, 'probability_not_in_range', '', 1 FROM bad_prediction WHERE accept_probability > 1
  UNION ALL SELECT system || ':' || forum_id, 'duplicate_forum_id', '', count(*) - 1 FROM bad_prediction
    WHERE forum_id <> '' GROUP BY 1 HAVING count(*) > 1""")
def q3(spark, path):
    rules = R.prediction_rules(_bad_predictions(spark, path))
    # Numbers print differently in the two engines; the detail of this rule is left out.
    return rules.withColumn("detail", F.when(F.col("rule") == "probability_not_in_range", "")
                            .otherwise(F.col("detail")))


@query("F14_prediction_records_from_json", """
  SELECT forum_id AS entity_id, rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS forum_id, unnest(CASE o_orderstatus
      WHEN 'F' THEN ['rating_not_numeric', 'probability_not_in_range']
      WHEN 'O' THEN ['decision_not_allowed', 'probability_not_in_range'] ELSE []::VARCHAR[] END) AS rule FROM orders)""")
def f14(spark, path):
    o = D.table(spark, path, "orders")
    record = F.concat(F.lit('{"predictions": ['), _record(), F.lit("]}"))
    rows = R.parse_predictions(o.select(F.lit("generic").alias("system"), record.alias("json")))
    return R.variant_schema_rules(rows)


def _record():
    """An order as a prediction record, with faults by its status."""
    return F.concat(
        F.lit('{"forum_id": "'), F.col("o_orderkey").cast("string"), F.lit('"'),
        F.when(F.col("o_orderstatus") == "F", ', "rating_prediction": true, "accept_probability": "0.5"')
        .when(F.col("o_orderstatus") == "O", ', "decision_prediction": 1, "accept_probability": 1.5')
        .otherwise(', "rating_prediction": 5, "decision_prediction": "accept", "accept_probability": 1'),
        F.lit("}"))


@query("F14_predictions_from_one_file", """
  SELECT forum_id AS entity_id, rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS forum_id, unnest(CASE o_orderstatus
      WHEN 'F' THEN ['rating_not_numeric', 'probability_not_in_range']
      WHEN 'O' THEN ['decision_not_allowed', 'probability_not_in_range'] ELSE []::VARCHAR[] END) AS rule FROM orders)
  UNION ALL SELECT '#' || (SELECT count(*) FROM orders), 'missing_forum_id', '', CAST(1 AS BIGINT)""")
def f14_file(spark, path):
    """One run file with all records and a last one without an id."""
    o = D.table(spark, path, "orders").select(F.col("o_orderkey").alias("n"), F.concat(_record(), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(-1, '{"system": "generic", "predictions": ['), (2**62, '{"rating_prediction": 5}]}')], "n long, value string")
    return R.variant_schema_rules(R.load_predictions(spark, one_document(spark, o.unionByName(ends), ["n"]), "generic", 1 << 18, parts=True))


@query("J8_Q4_predictions_outside_dataset", """
  SELECT system || ':' || forum_id AS entity_id, 'outside_evaluation_set' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n
  FROM prediction WHERE forum_id NOT IN (SELECT forum_id FROM eval_forum)""")
def j8(spark, path):
    inputs = _split(spark, path).where(F.col("reason").isNull())
    return R.outside_dataset(D.predictions(spark, path), inputs)


@query("Q4_missing_predictions", """
  SELECT e.forum_id, s.system FROM eval_forum e, (SELECT DISTINCT system FROM prediction) s
  WHERE (s.system, e.forum_id) NOT IN (SELECT (system, forum_id) FROM prediction)""")
def q4(spark, path):
    inputs = _split(spark, path).where(F.col("reason").isNull())
    p = D.predictions(spark, path)
    return R.missing_predictions(p, inputs)


@query("W7_duplicate_ids", """
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, 'duplicate_customer' AS rule, '' AS detail, count(*) - 1 AS n
  FROM orders GROUP BY 1 HAVING count(*) > 1""")
def w7(spark, path):
    return E.duplicates(D.table(spark, path, "orders"), "o_custkey", "duplicate_customer")


@query("J9_forum_set_differences", """
  SELECT o_orderkey AS forum_id, CASE o_orderstatus WHEN 'F' THEN 'generic' ELSE 'calibrated' END AS only_in
  FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def j9(spark, path):
    o = D.table(spark, path, "orders")
    run = lambda system, *kinds: o.where(F.col("o_orderstatus").isin(*kinds)).select(
        F.col("o_orderkey").alias("forum_id"), F.lit(system).alias("system"))
    both = run("generic", "F", "O").unionByName(run("calibrated", "O", "P"))
    return R.forum_set_differences(both, "generic", "calibrated")


def _runs(spark, path, ds):
    """Run headers of two systems; digests come from the dataset's manifest."""
    systems = D.predictions(spark, path).select("system").distinct()
    generic = F.col("system") == S.SYSTEM_GENERIC
    return with_row(systems, ds.manifest.select("model_inputs_hash", "calibration_hash")).select(
        F.concat(F.lit("run_"), "system").alias("run_id"), "system",
        F.when(generic, "model-a").otherwise("model-b").alias("model"),
        F.when(generic, '{"temperature": 0}').otherwise("[1]").alias("settings"),
        F.when(generic, F.col("model_inputs_hash")).otherwise("stale").alias("input_hash"),
        F.when(generic, "none").otherwise(F.col("calibration_hash")).alias("calibration_hash"),
        F.when(generic, "2026-01-01T00:00:00Z").alias("created_at"))


RUN_PROBLEMS = """(VALUES ('run', 'model_mismatch'), ('run', 'settings_mismatch'), ('run', 'input_hash_mismatch'),
    ('run', 'calibrated_input_hash_stale'))"""


@query("Q5_run_comparability", f"""
  SELECT a AS entity_id, b AS rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM {RUN_PROBLEMS} v(a, b)
  WHERE (SELECT count(*) FROM prediction) > 0""")
def q5(spark, path):
    ds = _dataset(spark, path)[2]
    return R.comparability(_runs(spark, path, ds), ds.manifest, D.predictions(spark, path))


@query("Q6_dataset_consistency", """
  SELECT CAST(forum_id AS VARCHAR) AS entity_id, 'calibration_evaluation_overlap' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n
    FROM eval_forum WHERE segment = 'MACHINERY'
  UNION ALL SELECT 'dataset', 'calibration_ids_tampered', '', 1 FROM inputs_hash
  UNION ALL SELECT 'dataset', 'manifests_disagree.seed', '', 1 FROM inputs_hash""")
def q6(spark, path):
    c, _, ds = _dataset(spark, path)
    # A tampered calibration set that overlaps, and a split manifest with another seed.
    forged = c.forum.where(F.col("segment") == "MACHINERY").select("forum_id")
    split_manifest = ds.manifest.withColumn("seed", F.lit(7))
    return R.dataset_consistency(ds.inputs, ds.labels, forged, ds.manifest, split_manifest)


_Q8 = f"""
  SELECT 'membership' AS source, system || ':' || forum_id AS entity_id, 'outside_evaluation_set' AS rule, '' AS detail,
    CAST(1 AS BIGINT) AS n FROM prediction WHERE forum_id NOT IN (SELECT forum_id FROM eval_forum)
  UNION ALL SELECT 'comparability', a, b, '', 1 FROM {RUN_PROBLEMS} v(a, b)
  UNION ALL SELECT 'run', 'run_calibrated', 'settings_not_an_object', '', 1
  UNION ALL SELECT 'run', 'run_calibrated', 'missing_run_field.created_at', '', 1"""


@query("Q8_leakage_report", _Q8)
def q8(spark, path):
    _, cal, ds = _dataset(spark, path)
    p = D.predictions(spark, path).withColumn("position", F.lit(0))
    return R.leakage_report(ds.inputs, ds.labels, cal, ds.manifest, ds.manifest,
                            _runs(spark, path, ds), p)


# --- scores -----------------------------------------------------------------------------

cte("paired", """
  SELECT p.system, l.venue_family, l.venue_year, p.forum_id, initial_rating_eligible AS re, initial_rating_target AS a,
    rating_prediction AS p, final_decision_eligible AS de, final_decision_target AS dt, decision_prediction AS dp,
    accept_probability AS prob
  FROM label l JOIN prediction p ON l.forum_id = p.forum_id
""")
cte("paired2", """
  SELECT * FROM paired UNION ALL SELECT system, 'all', 'all', forum_id, re, a, p, de, dt, dp, prob FROM paired
""")
cte("ranked", """
  SELECT *, rank() OVER (PARTITION BY system, venue_family, venue_year ORDER BY a)
      + (count(*) OVER (PARTITION BY system, venue_family, venue_year, a) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY system, venue_family, venue_year ORDER BY p)
      + (count(*) OVER (PARTITION BY system, venue_family, venue_year, p) - 1) / 2 AS rp
  FROM paired2 WHERE re AND p IS NOT NULL
""")
cte("rating_score", f"""
  SELECT system, venue_family, venue_year, count(*) AS sample_size, round(avg(abs(p - a)), {DIGITS}) AS mae,
    round(median(abs(p - a)), {DIGITS}) AS median_absolute_error,
    CASE WHEN count(*) >= 2 AND var_pop(ra) > 0 AND var_pop(rp) > 0
      THEN round(covar_pop(ra, rp) / sqrt(var_pop(ra) * var_pop(rp)), {DIGITS}) END AS spearman
  FROM ranked GROUP BY 1, 2, 3
""")
cte("decision_score", f"""
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
    ELSE round(2 * precision * recall / (precision + recall), {DIGITS}) END AS f1
  FROM (SELECT *, tp + fn + fp + tn AS sample_size, round((tp + tn) / (tp + fn + fp + tn), {DIGITS}) AS accuracy,
      CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), {DIGITS}) END AS precision,
      CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), {DIGITS}) END AS recall
    FROM (SELECT system, venue_family, venue_year, count(*) FILTER (dt = 'accept' AND dp = 'accept') AS tp,
        count(*) FILTER (dt = 'accept' AND dp = 'reject') AS fn, count(*) FILTER (dt = 'reject' AND dp = 'accept') AS fp,
        count(*) FILTER (dt = 'reject' AND dp = 'reject') AS tn
      FROM paired2 WHERE de AND dp IS NOT NULL GROUP BY 1, 2, 3))
""")
cte("prob_score", f"""
  SELECT system, sum(n) AS sample_size, round(sum(sq) / sum(n), {DIGITS}) AS brier_score,
    round(sum(abs(sa - sp)) / sum(n), {DIGITS}) AS ece
  FROM (SELECT system, least(9, CAST(floor(prob * 10) AS INTEGER)) AS b, count(*) AS n, sum(prob) AS sp,
      CAST(count(*) FILTER (dt = 'accept') AS DOUBLE) AS sa,
      sum(pow(prob - CASE WHEN dt = 'accept' THEN 1 ELSE 0 END, 2)) AS sq
    FROM paired WHERE de AND prob IS NOT NULL GROUP BY 1, 2) GROUP BY 1
""")


def _paired(spark, path):
    return SC.pair(labels(spark, path), D.predictions(spark, path))


@query("J7_labels_with_predictions", """
  SELECT forum_id, system, venue_family, venue_year, re AS initial_rating_eligible, a AS initial_rating_target,
    de AS final_decision_eligible, dt AS final_decision_target, p AS rating_prediction, dp AS decision_prediction,
    prob AS accept_probability FROM paired""")
def j7(spark, path):
    return _paired(spark, path)


@query("A18_A19_rating_metrics_by_scope", "SELECT * FROM rating_score")
def a18(spark, path):
    pairs = SC.overall_and_scopes(SC.rating_pairs(_paired(spark, path)))
    return SC.rating_metrics(pairs, SC.KEYS, DIGITS)


@query("A19_pearson", f"""
  SELECT system, round(covar_pop(a, p) / sqrt(var_pop(a) * var_pop(p)), {DIGITS}) AS pearson
  FROM paired WHERE re AND p IS NOT NULL GROUP BY 1""")
def a19(spark, path):
    return SC.pearson(SC.rating_pairs(_paired(spark, path)), ["system"], DIGITS)


@query("A20_decision_metrics_by_scope", """
  SELECT system, venue_family, venue_year, tp, fn, fp, tn, sample_size, accuracy, precision, recall, f1 FROM decision_score""")
def a20(spark, path):
    pairs = SC.overall_and_scopes(SC.decision_pairs(_paired(spark, path)))
    return SC.decision_metrics(pairs, SC.KEYS, DIGITS)


@query("A21_A22_A25_probability_metrics", """
  SELECT system, CAST(sample_size AS BIGINT) AS sample_size, TRUE AS computed, CAST(NULL AS VARCHAR) AS reason, brier_score, ece FROM prob_score""")
def a21(spark, path):
    return SC.probability_metrics(_paired(spark, path), D.predictions(spark, path), DIGITS)


@query("A23_breakdown_with_skipped_scopes", """
  SELECT system, venue_family, venue_year, sample_size,
    CASE WHEN sample_size < 150 THEN 'sample_size_below_150' END AS skipped_reason,
    CASE WHEN sample_size >= 150 THEN mae END AS mae,
    CASE WHEN sample_size >= 150 THEN median_absolute_error END AS median_absolute_error,
    CASE WHEN sample_size >= 150 THEN spearman END AS spearman
  FROM rating_score WHERE venue_family <> 'all'""")
def a23(spark, path):
    return SC.breakdown(a18(spark, path), min_n=150)


@query("A24_coverage", f"""
  SELECT system, task, eligible, predicted, round(predicted / eligible, {DIGITS}) AS coverage FROM (
    SELECT s.system, 'initial_rating' AS task, (SELECT count(*) FROM label WHERE initial_rating_eligible) AS eligible,
      (SELECT count(*) FROM paired q WHERE q.system = s.system AND re AND p IS NOT NULL) AS predicted FROM (SELECT DISTINCT system FROM prediction) s
    UNION ALL SELECT s.system, 'final_decision', (SELECT count(*) FROM label WHERE final_decision_eligible),
      (SELECT count(*) FROM paired q WHERE q.system = s.system AND de AND dp IS NOT NULL) FROM (SELECT DISTINCT system FROM prediction) s)""")
def a24(spark, path):
    p = D.predictions(spark, path)
    return SC.coverage(labels(spark, path), _paired(spark, path), p, DIGITS)


cte("score", """
  SELECT system, 'initial_rating' AS task, CAST(sample_size AS BIGINT) AS sample_size, m[1] AS metric, CAST(m[2] AS DOUBLE) AS value
  FROM (SELECT system, sample_size, unnest([('mae', mae), ('median_absolute_error', median_absolute_error), ('spearman', spearman)]) AS m
    FROM rating_score WHERE venue_family = 'all')
  UNION ALL SELECT system, 'final_decision', CAST(sample_size AS BIGINT), m[1], m[2]
  FROM (SELECT system, sample_size, unnest([('accuracy', accuracy), ('precision', precision), ('recall', recall), ('f1', f1)]) AS m
    FROM decision_score WHERE venue_family = 'all')
  UNION ALL SELECT system, 'probability', CAST(sample_size AS BIGINT), m[1], m[2]
  FROM (SELECT system, sample_size, unnest([('brier_score', brier_score), ('ece', ece)]) AS m FROM prob_score)
""")


def score(spark, path):
    return SC.score(labels(spark, path), D.predictions(spark, path), DIGITS)


query("C4_scores_per_system", "SELECT * FROM score")(score)


# The same over the evaluation set, with the baseline.
cte("e_prediction", """
  SELECT * FROM prediction WHERE forum_id IN (SELECT forum_id FROM eval_forum)
  UNION ALL SELECT forum_id, 'baseline', mean_initial_rating, majority_decision, NULL FROM eval_forum, cal_aggregate
""")
for _name in ("paired", "paired2", "ranked", "rating_score", "decision_score", "prob_score", "score"):
    cte(f"e_{_name}", re.sub(r"\b(prediction|paired2?|ranked|rating_score|decision_score|prob_score)\b", r"e_\1", CTES[_name]))


cte("e_all", """
  SELECT s.system, f.forum_id, l.initial_rating_eligible AS re, l.final_decision_eligible AS de, q.rating_prediction AS p,
    q.decision_prediction AS dp, s.system = 'baseline' OR q.forum_id IS NOT NULL AS has
  FROM eval_forum f JOIN label l USING (forum_id) CROSS JOIN (SELECT DISTINCT system FROM e_prediction) s
  LEFT JOIN e_prediction q ON q.forum_id = f.forum_id AND q.system = s.system
""")


def _gated(spark, path, runs, predictions, ds, cal):
    out = scratch_dir(spark)
    return EV.evaluate(ds, cal, a17(spark, path), runs, predictions, f"{out}/evaluation", digits=DIGITS)


@query("C4_gated_evaluation", f"""
  SELECT 'score' AS part, system, task, metric, value, sample_size AS n FROM e_score
  UNION ALL SELECT 'score', 'baseline', 'probability', unnest(['brier_score', 'ece']), NULL, 0
  UNION ALL SELECT 'delta', '', task, metric, round(max(value) FILTER (system = 'calibrated')
    - max(value) FILTER (system = 'generic'), {DIGITS}), NULL FROM e_score GROUP BY task, metric
  UNION ALL SELECT 'coverage', system, 'initial_rating', '', round(count(*) FILTER (re AND p IS NOT NULL)
    / count(*) FILTER (re), {DIGITS}), count(*) FILTER (re AND p IS NOT NULL) FROM e_all GROUP BY system
  UNION ALL SELECT 'coverage', system, 'final_decision', '', round(count(*) FILTER (de AND dp IS NOT NULL)
    / count(*) FILTER (de), {DIGITS}), count(*) FILTER (de AND dp IS NOT NULL) FROM e_all GROUP BY system
  UNION ALL SELECT 'missing', system, CAST(forum_id AS VARCHAR), '', NULL, NULL FROM e_all WHERE NOT has""")
def c4_gated(spark, path):
    """Two runs that differ in their calibration alone pass all checks and are scored beside the baseline."""
    _, cal, ds = _dataset(spark, path)
    side = lambda system, hashed: ds.manifest.select(*[v.alias(c) for c, v in {
        "run_id": F.lit(f"run_{system}"), "system": F.lit(system), "model": F.lit("m"), "settings": F.lit('{"t": 0}'),
        "input_hash": F.col("model_inputs_hash"), "calibration_hash": hashed, "created_at": F.lit("2026-01-01")}.items()])
    runs = side("generic", F.lit(S.NO_CALIBRATION)).unionByName(side("calibrated", F.col("calibration_hash")))
    inside = D.predictions(spark, path).join(ds.inputs.select("forum_id"), "forum_id", "left_semi")
    ev, none = _gated(spark, path, runs, inside, ds, cal), F.lit(None)
    named = lambda df, *cols: df.select(*[c.alias(n) for c, n in zip(cols, ("part", "system", "task", "metric", "value", "n"))])
    c, t = F.col, F.lit
    return (
        named(ev.scores, t("score"), c("system"), c("task"), c("metric"), c("value"), c("sample_size").cast("bigint"))
        .unionByName(named(ev.deltas, t("delta"), t(""), c("task"), c("metric"), c("delta"), none.cast("bigint")))
        .unionByName(named(ev.coverage, t("coverage"), c("system"), c("task"), t(""), c("coverage"), c("predicted").cast("bigint")))
        .unionByName(named(ev.missing, t("missing"), c("system"), c("forum_id").cast("string"), t(""), none.cast("double"), none.cast("bigint"))))


@query("C4_refused_evaluation", _Q8)
def c4_refused(spark, path):
    """The runs and predictions of Q8 break rules: nothing is scored, every violation is reported."""
    _, cal, ds = _dataset(spark, path)
    try:
        _gated(spark, path, _runs(spark, path, ds), D.predictions(spark, path), ds, cal)
    except EV.EvaluationRefused as refused:
        return refused.violations
    raise AssertionError("an evaluation that breaks rules was scored")


@query("J18_system_deltas", f"""
  SELECT task, metric, max(value) FILTER (system = 'generic') AS base, max(value) FILTER (system = 'calibrated') AS other,
    round(max(value) FILTER (system = 'calibrated') - max(value) FILTER (system = 'generic'), {DIGITS}) AS delta
  FROM score GROUP BY 1, 2""")
def j18(spark, path):
    return SC.deltas(score(spark, path), digits=DIGITS)


@query("A26_warnings", """
  SELECT DISTINCT system, 'initial_rating' AS task, 'small_sample' AS warning, count(*) AS n
  FROM paired WHERE re AND p IS NOT NULL GROUP BY 1 HAVING count(*) < 10000000
  UNION ALL SELECT system, 'final_decision', 'small_sample', count(*) FROM paired WHERE de AND dp IS NOT NULL
  GROUP BY 1 HAVING count(*) < 10000000""")
def a26(spark, path):
    cov = a24(spark, path)
    return SC.warnings(cov, labels(spark, path), small=10_000_000)

